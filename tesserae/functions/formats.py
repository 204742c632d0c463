"""Pixel formats as pairs of column expressions.

An encoded pixel is an integer code (its bytes read from the first to the last, high to low, for
byte formats; the value for packed ones). Decoding gives the four channels (0..255). A conversion
is the composition of a decoder and an encoder, except between siblings (byte orders of one format),
which are swapped directly, and indexed sources, which look their palette up by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Channels = tuple[Column, Column, Column, Column]


@dataclass(frozen=True)
class Format:
    """A name, the bits of a pixel, and how to read and write it; sibling: the same pixels in another byte order."""

    name: str
    bits: int
    decode: Callable[[Column], Channels]
    encode: Callable[[Column, Column, Column, Column], Column]
    alpha: bool = False
    indexed: bool = False
    sibling: str | None = None
    msb_first: bool = True

    @property
    def packed(self) -> bool:
        return self.bits < 8


def _and(c: Column, m: int) -> Column:
    return c.bitwiseAND(F.lit(m))


def _right(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


def _left(c: Column, n: int) -> Column:
    return F.shiftleft(c, n)


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma in integers, rounded."""
    return _right(r * 77 + g * 150 + b * 29 + 128, 8)


def _opaque(r: Column, g: Column, b: Column) -> Channels:
    return r, g, b, F.lit(255)


def _wide5(v: Column) -> Column:
    return _left(v, 3).bitwiseOR(_right(v, 2))


def _wide6(v: Column) -> Column:
    return _left(v, 2).bitwiseOR(_right(v, 4))


def swap16(c: Column) -> Column:
    """The two bytes of a 16-bit code in the other order."""
    return _left(_and(c, 255), 8).bitwiseOR(_right(c, 8))


def _from565(c: Column) -> Channels:
    return _opaque(_wide5(_and(_right(c, 11), 31)), _wide6(_and(_right(c, 5), 63)), _wide5(_and(c, 31)))


def _to565(r: Column, g: Column, b: Column, a: Column) -> Column:
    return _left(_right(r, 3), 11).bitwiseOR(_left(_right(g, 2), 5)).bitwiseOR(_right(b, 3))


def _from332(c: Column) -> Channels:
    return _opaque(_right(_and(_right(c, 5), 7) * 73, 1), _right(_and(_right(c, 2), 7) * 73, 1), _and(c, 3) * 85)


def _to332(r: Column, g: Column, b: Column, a: Column) -> Column:
    return _left(_right(r, 5), 5).bitwiseOR(_left(_right(g, 5), 2)).bitwiseOR(_right(b, 6))


def _gray(bits: int) -> tuple[Callable[[Column], Channels], Callable]:
    step = 255 // ((1 << bits) - 1)
    return lambda c: _opaque(c * step, c * step, c * step), lambda r, g, b, a: _right(luma(r, g, b), 8 - bits)


def _all() -> dict[str, Format]:
    out = [
        Format("RGBA8_Straight", 32, lambda c: (_and(F.shiftrightunsigned(c, 24), 255), _and(_right(c, 16), 255), _and(_right(c, 8), 255), _and(c, 255)), lambda r, g, b, a: _left(r, 24).bitwiseOR(_left(g, 16)).bitwiseOR(_left(b, 8)).bitwiseOR(a), alpha=True),
        Format("RGB565_LE", 16, lambda c: _from565(swap16(c)), lambda *p: swap16(_to565(*p)), sibling="RGB565_BE"),
        Format("RGB565_BE", 16, _from565, _to565, sibling="RGB565_LE"),
        Format("RGB332", 8, _from332, _to332),
        Format("RGB888", 24, lambda c: _opaque(_right(c, 16), _and(_right(c, 8), 255), _and(c, 255)), lambda r, g, b, a: _left(r, 16).bitwiseOR(_left(g, 8)).bitwiseOR(b), sibling="BGR888"),
        Format("BGR888", 24, lambda c: _opaque(_and(c, 255), _and(_right(c, 8), 255), _right(c, 16)), lambda r, g, b, a: _left(b, 16).bitwiseOR(_left(g, 8)).bitwiseOR(r), sibling="RGB888"),
        Format("Alpha8", 8, lambda c: (c, c, c, c), lambda r, g, b, a: a, alpha=True),
    ]
    for bits in (8, 4, 2, 1):
        read, write = _gray(bits)
        for kind in ("Grayscale", "Index"):
            if bits == 8:
                out.append(Format(f"{kind}8", 8, read, write, indexed=kind == "Index"))
            else:
                for order in ("MSB", "LSB"):
                    out.append(Format(f"{kind}{bits}_{order}", bits, read, write, indexed=kind == "Index", sibling=f"{kind}{bits}_{'LSB' if order == 'MSB' else 'MSB'}", msb_first=order == "MSB"))
    return {f.name: f for f in out}


FORMATS = _all()


def lookup(name: str) -> Format:
    """A format by its exact name; RGBA8 for an unknown one."""
    return FORMATS.get(name, FORMATS["RGBA8_Straight"])


def register(fmt: Format) -> None:
    """Add a format of one's own."""
    FORMATS[fmt.name] = fmt


def normalised(df: DataFrame) -> DataFrame:
    """Colours under zero alpha don't mean anything: they become zero."""
    seen = F.col("a") > 0
    return df.withColumns({c: F.when(seen, F.col(c)).otherwise(0) for c in "rgb"})


def encode(df: DataFrame, fmt: str, out: str = "code") -> DataFrame:
    """Adds the code of each pixel."""
    return df.withColumn(out, lookup(fmt).encode(*(F.col(c) for c in "rgba")).cast("int"))


def decode(df: DataFrame, fmt: str, code: str = "code") -> DataFrame:
    """Replaces codes by channels; indices without a palette read as gray."""
    return df.withColumns(dict(zip("rgba", (c.cast("int") for c in lookup(fmt).decode(F.col(code))), strict=True)))


def expand_palette(df: DataFrame, palette: DataFrame, palette_id: int = 0, index: str = "idx") -> DataFrame:
    """Looks indices up; a missing entry gives zeros. Palettes have at most 256 entries, so they are broadcast."""
    p = palette.where(F.col("palette_id") == palette_id).where(F.col("idx").between(0, 255)).select(F.col("idx").alias("_idx"), *(F.col(c).alias(f"_{c}") for c in "rgba"))
    found = df.join(F.broadcast(p), F.col(index) == F.col("_idx"), "left")
    return found.withColumns({c: F.coalesce(f"_{c}", F.lit(0)) for c in "rgba"}).drop("_idx", *(f"_{c}" for c in "rgba"))


def expand_versions(df: DataFrame, palettes: DataFrame, version: str = "frame", index: str = "idx") -> DataFrame:
    """Looks indices up in a palette that changes with a version column; a missing entry gives zeros."""
    p = palettes.select(F.col(version).alias("_v"), F.col("idx").alias("_idx"), *(F.col(c).alias(f"_{c}") for c in "rgba"))
    found = df.join(p, (F.col(version) == F.col("_v")) & (F.col(index) == F.col("_idx")), "left")
    return found.withColumns({c: F.coalesce(f"_{c}", F.lit(0)) for c in "rgba"}).drop("_v", "_idx", *(f"_{c}" for c in "rgba"))


def map_values(df: DataFrame, table: list[int], value: str = "v") -> DataFrame:
    """Values looked up in a table of at most 256 entries."""
    return df.withColumn(value, F.element_at(F.array(*map(F.lit, table)), F.col(value) + 1))


def convert(df: DataFrame, source: str, target: str, palette: DataFrame | None = None, code: str = "code") -> DataFrame:
    """Codes of one format as codes of another, by the shortest way."""
    s, t = lookup(source), lookup(target)
    if s.name == t.name:
        return df
    if s.sibling == t.name:
        if s.bits == 16:
            return df.withColumn(code, swap16(F.col(code)))
        if s.packed:  # the value of a packed pixel is the same in both orders
            return df
        c = F.col(code)
        return df.withColumn(code, _left(_and(c, 255), 16).bitwiseOR(_and(c, 0xFF00)).bitwiseOR(_right(c, 16)))
    if s.indexed and palette is not None:
        channels = expand_palette(df, palette, index=code)
    else:
        channels = decode(df, source, code)
    return channels.withColumn(code, t.encode(*(F.col(c) for c in "rgba")).cast("int")).select(*df.columns)


def pack_rows(df: DataFrame, fmt: str, value: str = "code", offset: int = 0) -> DataFrame:
    """(image_id, y, byte, v): pixels of a packed format joined into bytes; offset pixels are left free before x 0."""
    f = lookup(fmt)
    per = 8 // f.bits
    at = F.col("x") + offset
    place = at % per
    shift = ((per - 1 - place) if f.msb_first else place) * f.bits
    return df.groupBy("image_id", "y", F.floor(at / per).cast("int").alias("byte")).agg(F.sum(F.call_function("shiftleft", F.col(value), shift.cast("int"))).cast("int").alias("v"))


def unpack_rows(df: DataFrame, fmt: str, offset: int = 0) -> DataFrame:
    """(image_id, y, x, code): the pixels of packed bytes; those before the offset are left out."""
    f = lookup(fmt)
    per = 8 // f.bits
    wide = df.select("image_id", "y", "byte", "v", F.explode(F.array(*map(F.lit, range(per)))).alias("k"))
    shift = ((per - 1 - F.col("k")) if f.msb_first else F.col("k")) * f.bits
    value = _and(F.call_function("shiftright", F.col("v"), shift.cast("int")), (1 << f.bits) - 1)
    return wide.select("image_id", "y", (F.col("byte") * per + F.col("k") - offset).cast("int").alias("x"), value.cast("int").alias("code")).where("x >= 0")


# --- 16-bit premultiplied pixels of the first generation --------------------------------------


def premultiplied(df: DataFrame) -> DataFrame:
    """r, g, b, a as 16-bit premultiplied: colours times (a + 1), alpha 255 times (a + 1)."""
    up = F.col("a") + 1
    return df.withColumns({**{c: F.col(c) * up for c in "rgb"}, "a": up * 255})


def straight(df: DataFrame) -> DataFrame:
    """The way back: alpha is the high byte, colours are divided by it plus 1."""
    a = F.shiftright("a", 8)
    return df.withColumns({**{c: F.call_function("div", F.col(c), a + 1).cast("int") for c in "rgb"}, "a": a})


def read_pixel(data: Column, x: Column, fmt: str, offset: int = 0) -> Column:
    """One pixel of a packed line (binary), without unpacking the others; null beyond its end."""
    f = lookup(fmt)
    per = 8 // f.bits
    at = x + offset
    place = at % per
    shift = ((per - 1 - place) if f.msb_first else place) * f.bits
    byte = F.conv(F.hex(F.substr(data, F.floor(at / per).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.when((at >= 0) & (at < F.length(data) * per), _and(F.call_function("shiftright", byte, shift.cast("int")), (1 << f.bits) - 1))
