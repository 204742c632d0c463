"""Box blurs over sparse pixels.

A pixel adds its part to a running sum where its box begins and takes it away where the box ends;
between such events the sums are constant, so a pass is: two events a pixel, a sum by place, a
running sum along the line, and a run of output pixels from each event to the next. The cost
doesn't depend on the radius. Lines are dealt out once; all passes along one axis stay in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _div(a, b):
    return F.call_function("div", a, b)


def box_blur(df: DataFrame, axis: str, radius: int, passes: int = 1) -> DataFrame:
    """Alpha-weighted blur along x or y; the image grows by radius on both sides in each pass.

    Colours are sum(c * a) / sum(a), alpha is sum(a) / (2 radius + 1), all cut to integers in each
    pass; absent pixels count as transparent, and transparent results are absent.
    """
    if radius <= 0 or passes <= 0:
        return df
    line = "y" if axis == "x" else "x"
    out = df.where("a > 0").select("image_id", "y", "x", *"rgba").repartition("image_id", line)
    for _ in range(passes):
        out = _pass(out, axis, line, radius)
    return out.select("image_id", "y", "x", *"rgba")


def _pass(df: DataFrame, axis: str, line: str, radius: int) -> DataFrame:
    a = F.col("a").cast("long")
    parts = [*((F.col(c) * a).alias(c) for c in "rgb"), a.alias("a")]
    events = df.select("image_id", line, F.explode(F.array(F.struct((F.col(axis) - radius).alias("at"), F.lit(1).alias("sign")), F.struct((F.col(axis) + radius + 1).alias("at"), F.lit(-1).alias("sign")))).alias("e"), *parts)
    here = events.groupBy("image_id", line, F.col("e.at").alias("at")).agg(*(F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in "rgba"))
    ordered = Window.partitionBy("image_id", line).orderBy("at")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = here.select("image_id", line, "at", F.lead("at").over(ordered).alias("until"), *(F.sum(c).over(running).alias(c) for c in "rgba"))
    alive = sums.where(f"a >= {2 * radius + 1}")
    values = alive.select("image_id", line, F.sequence("at", F.col("until") - 1).alias("run"), *(_div(F.col(c), F.col("a")).cast("int").alias(c) for c in "rgb"), _div(F.col("a"), F.lit(2 * radius + 1)).cast("int").alias("a"))
    return values.select("image_id", line, F.explode("run").alias(axis), *"rgba")


def blur_2d(df: DataFrame, radius: int, passes: int = 1) -> DataFrame:
    return box_blur(box_blur(df, "x", radius, passes), "y", radius, passes)


def mean_blur(df: DataFrame, radius: int) -> DataFrame:
    """First-generation blur: plain means of the pixels that are there, along x and then y; the image keeps its size."""
    out = df
    for axis, line in (("x", "y"), ("y", "x")):
        near = Window.partitionBy("image_id", line).orderBy(axis).rangeBetween(-radius, radius)
        out = out.select("image_id", "y", "x", *(_div(F.sum(c).over(near), F.count("*").over(near)).cast("int").alias(c) for c in "rgba"))
    return out
