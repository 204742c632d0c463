"""Spans, boxes and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import formats


def boxes(df: DataFrame) -> DataFrame:
    """The box of all pixels of an image: left and top, right and bottom excluded."""
    return df.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def spans(df: DataFrame) -> DataFrame:
    """The span of pixels in each line of an image, its end excluded."""
    return df.groupBy("image_id", "y").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def mask_spans(mask: DataFrame) -> DataFrame:
    """Spans of a mask's values without zeros at either end; lines of zeros are left out."""
    return spans(mask.where("v <> 0"))


def matte_spans(back: DataFrame, mask: DataFrame, front: DataFrame) -> DataFrame:
    """Spans that a matte can fill: the back's, joined with what mask and front share."""
    both = mask.join(front.withColumnsRenamed({"x0": "f0", "x1": "f1"}), ["image_id", "y"]).select("image_id", "y", F.greatest("x0", "f0").alias("x0"), F.least("x1", "f1").alias("x1")).where("x0 < x1")
    return back.unionByName(both).groupBy("image_id", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def dirty_spans(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """What has to be sent again: the union of a line's old and new span. One aggregation instead of an outer join."""
    both = before.select(*key, "x0", "x1").unionByName(now.select(*key, "x0", "x1"))
    return both.groupBy(*key).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def tile_overlaps(rects: DataFrame, tile: int, columns: int, rows: int) -> DataFrame:
    """(tile_x, tile_y, rect_id): the tiles of a grid that each rectangle touches, by arithmetic instead of a range join."""
    tx = F.sequence(F.greatest(F.lit(0), F.floor(F.col("x0") / tile).cast("int")), F.least(F.lit(columns - 1), F.floor((F.col("x0") + F.col("w") - 1) / tile).cast("int")))
    ty = F.sequence(F.greatest(F.lit(0), F.floor(F.col("y0") / tile).cast("int")), F.least(F.lit(rows - 1), F.floor((F.col("y0") + F.col("h") - 1) / tile).cast("int")))
    seen = rects.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x0") < columns * tile) & (F.col("y0") < rows * tile) & (F.col("x0") + F.col("w") > 0) & (F.col("y0") + F.col("h") > 0))
    wide = seen.select("rect_id", F.explode(tx).alias("tile_x"), ty.alias("_ys"))
    return wide.select(F.col("tile_x"), F.explode("_ys").alias("tile_y"), "rect_id")


def dirty_pixels(dirty: DataFrame, now: DataFrame, key: list[str], fmt: str = "RGB565_BE") -> DataFrame:
    """What a display gets: each cell of the dirty spans with its code in the format, zero where nothing is any more."""
    cells = dirty.select(*key, F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    codes = formats.encode(now, fmt).select(*key, "x", "code")
    return cells.join(codes, [*key, "x"], "left").select(*key, "x", F.coalesce("code", F.lit(0)).alias("code"))


# Debug colours.
OUTSIDE, LOOSE, EDGE, END = (255, 0, 255, 255), (0, 100, 255, 255), (255, 140, 0, 200), (0, 255, 100, 128)


def range_overlay(df: DataFrame, exact: DataFrame, box: DataFrame, buffers: DataFrame | None = None) -> DataFrame:
    """Debug colours: magenta outside an image's box, blue inside the box but outside the line's exact span.

    With buffers (spans of what each line holds), their first and last pixels are tinted orange, then those of the exact span green.
    """
    joined = df.join(box.select("image_id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1")), "image_id", "left")
    joined = joined.join(exact.withColumnsRenamed({"x0": "sx0", "x1": "sx1"}), ["image_id", "y"], "left")
    inside = F.coalesce((F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1")), F.lit(False))
    within = F.coalesce((F.col("x") >= F.col("sx0")) & (F.col("x") < F.col("sx1")), F.lit(False))
    shade = {c: F.when(~inside, m).when(~within, b).otherwise(F.col(c)) for c, m, b in zip("rgba", OUTSIDE, LOOSE, strict=True)}
    if buffers is None:
        return joined.select("image_id", "y", "x", *(v.cast("int").alias(c) for c, v in shade.items()))
    out = joined.withColumns(shade).join(buffers.withColumnsRenamed({"x0": "ox0", "x1": "ox1"}), ["image_id", "y"], "left")
    at = lambda low, high: F.coalesce((F.col("x") == F.col(low)) | (F.col("x") == F.col(high) - 1), F.lit(False))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    for hit, color, mix in (
        (at("ox0", "ox1"), EDGE, lambda c, v: div(F.col(c) * (255 - EDGE[3]) + v * EDGE[3], 255)),
        (at("sx0", "sx1"), END, lambda c, v: div(F.col(c) + v, 2)),
    ):
        out = out.withColumns({**{c: F.when(hit, mix(c, v)).otherwise(F.col(c)) for c, v in zip("rgb", color, strict=False)}, "a": F.when(hit, 255).otherwise(F.col("a"))})
    return out.select("image_id", "y", "x", *(F.col(c).cast("int").alias(c) for c in "rgba"))
