"""Crop, move and affine sampling.

Sampling turns the usual loop around: instead of looking a source pixel up for each output cell (a
join of a generated grid), each present source pixel emits the output cells that sample it. The
cells are those of its image's bounding box for which the exact inverse mapping comes back to
the pixel, so the result equals the lookup, and the plan is narrow: no grid, no join, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.fixed import HALF, ONE, Inverse, Matrix

#: Edges that fade out when sampling between pixels.
LEFT, RIGHT, TOP, BOTTOM = 1, 2, 4, 8
ALL_EDGES = LEFT | RIGHT | TOP | BOTTOM
Rect = tuple[int, int, int, int]  # left, top, right, bottom; the last two excluded


def crop(df: DataFrame, rect: Rect | None) -> DataFrame:
    """Pixels of a rectangle."""
    if rect is None:
        return df
    x0, y0, x1, y1 = rect
    return df.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))


def clear(df: DataFrame, rect: Rect) -> DataFrame:
    """Pixels outside a rectangle."""
    x0, y0, x1, y1 = rect
    return df.where(~(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)))


def move(df: DataFrame, dx: int, dy: int) -> DataFrame:
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def checkerboard(df: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Only tiles whose column and row number have an even sum."""
    tx, ty = F.floor(F.col("x") / tile_w), F.floor(F.col("y") / tile_h)
    return df.where(F.pmod(tx + ty, F.lit(2)) == 0)


def grown(rect: Rect | None, dx: int, dy: int) -> Rect | None:
    return None if rect is None else (rect[0] - dx, rect[1] - dy, rect[2] + dx, rect[3] + dy)


def _cells(df: DataFrame, m: Matrix, pivot: tuple[int, int], reach: float, rect: Rect | None) -> DataFrame:
    """Each source pixel (its place kept as _sx, _sy) with the output cells near its image."""
    px, py = pivot[0] / ONE, pivot[1] / ONE
    # the image of the square around a pixel is the same parallelogram everywhere
    left, top, right, bottom = Matrix(m.a, m.b, m.c, m.d).corners(-reach, -reach, 1 + reach, 1 + reach)
    at_x = F.lit(float(m.a)) * (F.col("x") - px) + F.lit(float(m.b)) * (F.col("y") - py) + float(m.tx)
    at_y = F.lit(float(m.c)) * (F.col("x") - px) + F.lit(float(m.d)) * (F.col("y") - py) + float(m.ty)

    # the centre of a cell lies in the image; the matrix in fixed point may be off by 2^-17 a pixel, over 32768 pixels a quarter
    slack = 0.05 + 0.3 * max(1.0, abs(m.a) + abs(m.b), abs(m.c) + abs(m.d))

    def span(at: Column, low: float, high: float, k: int) -> Column:
        a, b = F.ceil(at + (low - 0.5 - slack)).cast("int"), F.floor(at + (high - 0.5 + slack)).cast("int")
        if rect is not None:
            a, b = F.greatest(a, F.lit(rect[k])), F.least(b, F.lit(rect[k + 2] - 1))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    others = [c for c in df.columns if c not in ("x", "y")]
    wide = df.select(*others, F.col("x").alias("_sx"), F.col("y").alias("_sy"), span(at_y, top, bottom, 1).alias("_ys"), span(at_x, left, right, 0).alias("_xs"))
    return wide.withColumn("y", F.explode("_ys")).drop("_ys").withColumn("x", F.explode("_xs")).drop("_xs")


def _position(inv: Inverse, pivot: tuple[int, int]) -> tuple[Column, Column]:
    """Where the centre of an output cell lies in the source, in fixed point."""
    bx, by = inv.base(*pivot)
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    return x * inv.a + y * inv.b + bx, x * inv.c + y * inv.d + by


def source_rect(m: Matrix, rect: Rect | None, pivot: tuple[int, int], margin: int = 2) -> Rect | None:
    """The part of the source that an output rectangle can sample."""
    inv = m.inverse()
    if rect is None or inv is None:
        return None
    bx, by = inv.base(*pivot)
    points = [(x, y) for x in (rect[0], rect[2]) for y in (rect[1], rect[3])]
    xs = [(inv.a * x + inv.b * y + bx) >> 16 for x, y in points]
    ys = [(inv.c * x + inv.d * y + by) >> 16 for x, y in points]
    return min(xs) - margin, min(ys) - margin, max(xs) + margin + 1, max(ys) + margin + 1


def sample_nearest(df: DataFrame, m: Matrix, pivot: tuple[int, int] = (0, 0), rect: Rect | None = None, round_moves: bool = False) -> DataFrame:
    """The image under a matrix, nearest pixels; pivot (fixed point) lands on the world's origin. A singular matrix gives nothing.

    rect limits the output, and by the inverse bounds also what is read of the source.
    """
    inv = m.inverse(round_moves)
    if inv is None:
        return df.where(F.lit(False))
    if inv.is_move:  # no sampling: a shift of coordinates
        bx, by = inv.base(*pivot)
        return crop(move(df, -(bx >> 16), -(by >> 16)), rect)
    near = crop(df, source_rect(m, rect, pivot))
    sx, sy = _position(inv, pivot)
    hit = _cells(near, m, pivot, 0.01, rect).where((F.shiftright(sx, 16) == F.col("_sx")) & (F.shiftright(sy, 16) == F.col("_sy")))
    return hit.select(*df.columns)


def sample_each(df: DataFrame, matrices: list[Matrix], pivot: tuple[int, int] = (0, 0)) -> DataFrame:
    """First generation: the image is sampled anew at each matrix, the first one first, instead of once under their product."""
    for k, m in enumerate(matrices):
        df = sample_nearest(df, m, pivot if k == 0 else (0, 0), round_moves=True)
    return df


def _up(value: Column, by: int) -> Column:
    """value / by, rounded up, for either sign."""
    q = F.call_function("div", value, F.lit(by))
    return q + F.when((value > 0) & (q * by != value), 1).otherwise(0)


def row_spans(rows: DataFrame, m: Matrix, size: tuple[int, int], pivot: tuple[int, int] = (0, 0)) -> DataFrame:
    """x0 and x1 (excluded) of what an image covers in each line y under a matrix, in closed form; empty lines are left out."""
    inv = m.inverse()
    if inv is None:
        return rows.where(F.lit(False))
    bx, by = inv.base(*pivot)
    y = F.col("y").cast("long")
    low, high = F.lit(-(1 << 40)), F.lit(1 << 40)
    there = F.lit(True)
    for step, at, length in ((inv.a, y * inv.b + bx, size[0]), (inv.c, y * inv.d + by, size[1])):
        top = (length << 16) - at  # 0 <= step * x + at < length, in fixed point
        if step == 0:
            there = there & (at >= 0) & (top > 0)
        else:
            first, end = (-at, top) if step > 0 else (-top + 1, at + 1)  # abs(step) * x lies in [first, end)
            low, high = F.greatest(low, _up(first, abs(step))), F.least(high, _up(end, abs(step)))
    return rows.where(there).withColumns({"x0": low, "x1": high}).where("x0 < x1").withColumns({"x0": F.col("x0").cast("int"), "x1": F.col("x1").cast("int")})


def _weighted(df: DataFrame, m: Matrix, size: tuple[int, int], pivot: tuple[int, int], fade: int, rect: Rect | None) -> DataFrame | None:
    """Source pixels with the output cells they take part in: fx, fy, and for each corner whether it is this pixel and whether it fades."""
    inv = m.inverse()
    if inv is None:
        return None
    w, h = size
    near = crop(df, source_rect(m, rect, pivot, 3))
    wide = _cells(near, m, pivot, 1.6, rect)
    px, py = _position(inv, pivot)
    wide = wide.withColumns({"_px": px, "_py": py})
    inside = (
        (F.col("_px") >= (-HALF if fade & LEFT else 0))
        & (F.col("_px") < w * ONE + (HALF if fade & RIGHT else 0))
        & (F.col("_py") >= (-HALF if fade & TOP else 0))
        & (F.col("_py") < h * ONE + (HALF if fade & BOTTOM else 0))
    )
    wide = wide.where(inside).withColumns({"_qx": F.col("_px") - HALF, "_qy": F.col("_py") - HALF})
    wide = wide.withColumns({"_cx": F.shiftright("_qx", 16), "_cy": F.shiftright("_qy", 16), "_fx": F.shiftright("_qx", 8).bitwiseAND(F.lit(255)), "_fy": F.shiftright("_qy", 8).bitwiseAND(F.lit(255))})
    keep = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c))
    corner = {}
    for i in (0, 1):
        corner[f"_x{i}"] = keep(F.col("_cx") + i, w - 1) == F.col("_sx")
        corner[f"_y{i}"] = keep(F.col("_cy") + i, h - 1) == F.col("_sy")
    wide = wide.withColumns(corner)
    gone_x = {0: (F.col("_cx") < 0) if fade & LEFT else F.lit(False), 1: (F.col("_cx") >= w - 1) if fade & RIGHT else F.lit(False)}
    gone_y = {0: (F.col("_cy") < 0) if fade & TOP else F.lit(False), 1: (F.col("_cy") >= h - 1) if fade & BOTTOM else F.lit(False)}
    wide = wide.withColumns({f"_hit{i}{j}": F.col(f"_x{i}") & F.col(f"_y{j}") for i in (0, 1) for j in (0, 1)})
    wide = wide.withColumns({f"_live{i}{j}": F.col(f"_hit{i}{j}") & ~(gone_x[i] | gone_y[j]) for i in (0, 1) for j in (0, 1)})
    return wide.where(F.col("_hit00") | F.col("_hit10") | F.col("_hit01") | F.col("_hit11"))


def sample_bilinear(df: DataFrame, m: Matrix, size: tuple[int, int], pivot: tuple[int, int] = (0, 0), fade: int = ALL_EDGES, rect: Rect | None = None) -> DataFrame:
    """The image (width, height in size) under a matrix, between four pixels; edges in fade run out to transparent.

    Weights have 8 bits and sum to 256. Each pixel emits its weighted part of the cells it touches,
    and parts are summed by cell, with partial sums before the shuffle.
    """
    wide = _weighted(df, m, size, pivot, fade, rect)
    if wide is None:
        return df.where(F.lit(False))
    fx, fy = F.col("_fx"), F.col("_fy")
    w11, w10, w01 = F.shiftright(fx * fy, 8), F.shiftright(fx * (256 - fy), 8), F.shiftright((256 - fx) * fy, 8)
    weights = {"11": w11, "10": w10, "01": w01, "00": 256 - w11 - w10 - w01}
    total = lambda kind: sum(F.when(F.col(f"_{kind}{k}"), w).otherwise(0) for k, w in weights.items())
    wide = wide.withColumns({"_w": total("hit"), "_wa": total("live")})
    sums = wide.groupBy("image_id", "y", "x").agg(*(F.shiftright(F.sum(F.col("_w") * F.col(c)), 8).cast("int").alias(c) for c in "rgb"), F.shiftright(F.sum(F.col("_wa") * F.col("a")), 8).cast("int").alias("a"))
    return sums


def sample_bilinear_plane(df: DataFrame, m: Matrix, size: tuple[int, int], pivot: tuple[int, int] = (0, 0), fade: int = ALL_EDGES, rect: Rect | None = None) -> DataFrame:
    """The same for planes of one channel v, whose weights are whole products and are cut once, by 16 bits."""
    wide = _weighted(df, m, size, pivot, fade, rect)
    if wide is None:
        return df.where(F.lit(False))
    fx, fy = F.col("_fx"), F.col("_fy")
    weights = {"00": (256 - fx) * (256 - fy), "10": fx * (256 - fy), "01": (256 - fx) * fy, "11": fx * fy}
    part = sum(F.when(F.col(f"_live{k}"), w).otherwise(0) for k, w in weights.items())
    return wide.groupBy("image_id", "y", "x").agg(F.shiftright(F.sum(part * F.col("v")), 16).cast("int").alias("v"))


def bounds_of(m: Matrix, size: tuple[int, int], pivot: tuple[int, int] = (0, 0)) -> Rect:
    """The whole-pixel bounds of an image under a matrix."""
    px, py = pivot[0] / ONE, pivot[1] / ONE
    left, top, right, bottom = m.corners(-px, -py, size[0] - px, size[1] - py)
    return math.floor(left), math.floor(top), math.ceil(right), math.ceil(bottom)
