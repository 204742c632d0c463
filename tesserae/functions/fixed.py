"""Q16.16 fixed point: numbers of a plan on the driver, and the same arithmetic on columns.

Matrices are single-precision values, and become fixed-point constants of the plan: elements are
rounded (halves away from zero), translations and pivots are cut towards zero.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 16
ONE = 1 << SHIFT
HALF = ONE >> 1


def single(value: float) -> float:
    """The nearest single-precision number."""
    return struct.unpack("f", struct.pack("f", value))[0]


def to_fixed(value: int) -> int:
    return value << SHIFT


def from_fixed(value: int) -> int:
    """Towards zero, as a division."""
    return value // ONE if value >= 0 else -(-value // ONE)


def floor_fixed(value: int) -> int:
    return value >> SHIFT


def ceil_fixed(value: int) -> int:
    return -(-value >> SHIFT)


def round_fixed(value: int) -> int:
    return (value + HALF) >> SHIFT


def cut_fixed(value: float) -> int:
    """A float as fixed point, cut towards zero."""
    return math.trunc(single(single(value) * ONE))


def near_fixed(value: float) -> int:
    """A float as fixed point, halves away from zero."""
    scaled = single(value) * ONE
    return int(math.copysign(math.floor(abs(scaled) + 0.5), scaled))


def fixed_float(value: int) -> float:
    return value / ONE


def mul_fixed(a: int, b: int) -> int:
    return (a * b) >> SHIFT


def div_fixed(a: int, b: int) -> int:
    q = abs(a << SHIFT) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def floor_column(value: Column) -> Column:
    """Floor of a fixed-point column, also below zero."""
    return F.shiftright(value, SHIFT)


def ceil_column(value: Column) -> Column:
    return -F.shiftright(-value, SHIFT)


def round_column(value: Column) -> Column:
    return F.shiftright(value + HALF, SHIFT)


def whole_column(value: Column) -> Column:
    """Towards zero."""
    return F.call_function("div", value, F.lit(ONE))


def mul_column(a: Column, b: Column) -> Column:
    return F.shiftright(a.cast("long") * b.cast("long"), SHIFT)


def div_column(a: Column, b: Column) -> Column:
    """Null for a division by zero."""
    return F.when(b != 0, F.call_function("div", F.shiftleft(a.cast("long"), SHIFT), b.cast("long")))


@dataclass(frozen=True)
class Matrix:
    """[[a, b, tx], [c, d, ty]] in single precision; `m @ n` applies n first."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    tx: float = 0.0
    ty: float = 0.0

    def __matmul__(self, o: Matrix) -> Matrix:
        s = single
        return Matrix(
            s(s(self.a * o.a) + s(self.b * o.c)),
            s(s(self.a * o.b) + s(self.b * o.d)),
            s(s(self.c * o.a) + s(self.d * o.c)),
            s(s(self.c * o.b) + s(self.d * o.d)),
            s(s(s(self.a * o.tx) + s(self.b * o.ty)) + s(self.tx)),
            s(s(s(self.c * o.tx) + s(self.d * o.ty)) + s(self.ty)),
        )

    @classmethod
    def move(cls, x: float, y: float) -> Matrix:
        return cls(tx=single(x), ty=single(y))

    @classmethod
    def scale(cls, x: float, y: float) -> Matrix:
        return cls(a=single(x), d=single(y))

    @classmethod
    def turn(cls, radians: float, x: float = 1.0, y: float = 1.0) -> Matrix:
        """A rotation after a scale."""
        c, s = single(math.cos(single(radians))), single(math.sin(single(radians)))
        return cls(single(c * x), single(-s * y), single(s * x), single(c * y))

    def inverse(self, round_moves: bool = False) -> Inverse | None:
        """The fixed-point inverse; None for a singular matrix. The first generation rounds translations instead of cutting them."""
        det = single(single(self.a * self.d) - single(self.b * self.c))
        if abs(det) < 1e-10:
            return None
        over = single(1.0 / det)
        a, b, c, d = (near_fixed(single(v * over)) for v in (self.d, -self.b, -self.c, self.a))
        move = near_fixed if round_moves else cut_fixed
        tx, ty = move(self.tx), move(self.ty)
        return Inverse(a, b, c, d, -(tx * a + ty * b) >> SHIFT, -(tx * c + ty * d) >> SHIFT)

    def corners(self, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
        """The bounds (left, top, right, bottom) of a rectangle's image."""
        xs = [self.a * x + self.b * y + self.tx for x in (x0, x1) for y in (y0, y1)]
        ys = [self.c * x + self.d * y + self.ty for x in (x0, x1) for y in (y0, y1)]
        return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class Inverse:
    """A fixed-point inverse: (x, y) goes to (a x + b y + tx, c x + d y + ty)."""

    a: int
    b: int
    c: int
    d: int
    tx: int
    ty: int

    @property
    def is_move(self) -> bool:
        return (self.a, self.b, self.c, self.d) == (ONE, 0, 0, ONE)

    def base(self, pivot_x: int = 0, pivot_y: int = 0) -> tuple[int, int]:
        """Offsets that sample at pixel centres; pivots in fixed point."""
        return self.tx + pivot_x + (self.b >> 1) + (self.a >> 1), self.ty + pivot_y + (self.d >> 1) + (self.c >> 1)
