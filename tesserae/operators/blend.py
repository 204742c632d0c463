"""Layers put together: ordered blending, overwriting, and fades by a mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]
_PIXEL = "struct<r:int,g:int,b:int,a:int>"


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Frames as layers of one relation; the first is z 0, in front."""
    tagged = [f.select(*KEY, F.lit(z).alias("z"), *"rgba") for z, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged)


def opaque_cut(layers: DataFrame) -> DataFrame:
    """Without what lies behind the front-most opaque layer of its cell, in one aggregation. Ties at one z are kept; other columns aren't."""
    whole = layers.groupBy(*KEY).agg(F.collect_list(F.struct("z", *"rgba")).alias("_all"), _front().alias("_front"))
    return whole.select(*KEY, F.inline(_before(F.col("_all"), F.col("_front"))))


def _front() -> Column:
    return F.min(F.when(F.col("a") == 255, F.col("z")))


def _before(layers: Column, front: Column) -> Column:
    return F.when(front.isNull(), layers).otherwise(F.filter(layers, lambda p: p["z"] <= front))


def _under(d: Column, s: Column) -> Column:
    """What a pixel s adds under d."""
    t = d["a"] * 255 + s["a"] * (255 - d["a"])
    w = F.call_function("div", d["a"] * 65280 + F.shiftright(t, 1), t).cast("int")
    mixed = F.struct(*(F.shiftright(d[c] * w + s[c] * (256 - w), 8).alias(c) for c in "rgb"), F.call_function("div", t + 127, F.lit(255)).cast("int").alias("a"))
    plain = F.struct(*(s[c].alias(c) for c in "rgba"))
    return F.when((s["a"] == 0) | (d["a"] == 255), d).when(d["a"] == 0, plain).otherwise(mixed)


def _fold(layers: DataFrame, step, order: Column, cut: bool = False) -> DataFrame:
    empty = F.struct(*(F.lit(0).alias(c) for c in "rgba"))
    if cut:
        whole = layers.groupBy(*KEY).agg(F.collect_list(order).alias("_all"), _front().alias("_front"))
        whole = whole.select(*KEY, F.array_sort(_before(F.col("_all"), F.col("_front"))).alias("_all"))
    else:
        whole = layers.groupBy(*KEY).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    done = whole.select(*KEY, F.aggregate("_all", empty, step).alias("_p"))
    return done.select(*KEY, *(F.col(f"_p.{c}").alias(c) for c in "rgba"))


def composite_under(layers: DataFrame, cut: bool = False) -> DataFrame:
    """Layers (z 0 in front) blended from front to back; transparent results are left out.

    cut leaves out what lies behind an opaque layer before the sort; for many layers a cell.

    Each step rounds, so the order counts and there is no partial aggregate; transparent layers
    are dropped before the shuffle, as they change nothing. Layers at one z go by their channels.
    """
    order = F.struct("z", "r", "g", "b", "a")
    return _fold(layers.where("a > 0"), _under, order, cut).where("a > 0")


def composite_over(layers: DataFrame) -> DataFrame:
    """First-generation blending of 16-bit premultiplied layers: later z lie on top."""

    def step(d: Column, s: Column) -> Column:
        back = 65535 - s["a"]
        over = F.struct(*((s[c] + F.shiftright(d[c].cast("long") * back, 16).cast("int")).alias(c) for c in "rgba"))
        plain = F.struct(*(s[c].alias(c) for c in "rgba"))
        return F.when(s["a"] <= 255, d).when((s["a"] >= 65280) | (d["a"] == 0), plain).otherwise(over)

    return _fold(layers, step, F.struct("z", "r", "g", "b", "a"))


def overwrite(placed: DataFrame, rank: str = "rank") -> DataFrame:
    """Of pixels at one place the one of the highest rank, transparent ones too."""
    last = placed.groupBy(*KEY).agg(F.max_by(F.struct(*"rgba"), rank).alias("_p"))
    return last.select(*KEY, *(F.col(f"_p.{c}").alias(c) for c in "rgba"))


def matte(mask: DataFrame | None, front: DataFrame | None, back: DataFrame | None) -> DataFrame:
    """front where the mask (v) is full, back where it is empty, a fade between; what is missing is transparent.

    The three inputs are tagged and met in one aggregation with partial results, where a chain of
    outer joins would shuffle the back twice.
    """
    null = F.lit(None).cast("int")
    parts = []
    if mask is not None:
        parts.append(mask.select(*KEY, F.col("v").cast("int").alias("m"), *(null.alias(f"{s}{c}") for s in "fb" for c in "rgba")))
    if front is not None and mask is not None:
        parts.append(front.select(*KEY, null.alias("m"), *(F.col(c).alias(f"f{c}") for c in "rgba"), *(null.alias(f"b{c}") for c in "rgba")))
    if back is not None:
        parts.append(back.select(*KEY, null.alias("m"), *(null.alias(f"f{c}") for c in "rgba"), *(F.col(c).alias(f"b{c}") for c in "rgba")))
    met = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ["m", *(f"{s}{c}" for s in "fb" for c in "rgba")]))
    full = F.col("m") + F.shiftright("m", 7)
    out = met.select(*KEY, *(F.shiftright(F.col(f"b{c}") * (256 - full) + F.col(f"f{c}") * full, 8).alias(c) for c in "rgba"))
    return out.where("a > 0")
