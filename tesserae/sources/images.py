"""Images in and out: arrays, image files, test patterns, dense rows and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import formats

COLUMNS = ["image_id", "y", "x", "r", "g", "b", "a"]


def from_arrays(spark: SparkSession, images: dict[int, np.ndarray]) -> DataFrame:
    """Pixels of (height, width, 4) arrays of bytes by image id."""
    parts = []
    for image_id, data in images.items():
        h, w, _ = data.shape
        y, x = np.mgrid[0:h, 0:w]
        parts.append(pd.DataFrame({"image_id": image_id, "y": y.ravel(), "x": x.ravel(), **{c: data[..., k].ravel() for k, c in enumerate("rgba")}}).astype("int32"))
    return spark.createDataFrame(pd.concat(parts), "image_id int, y int, x int, r int, g int, b int, a int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, y, x and channels of image files. Spark's reader gives blue first, and 1, 3 or 4 channels.

    A file that can't be read fails the query, unless invalid_images() has shown it and it is left out of the path.
    """
    rows = spark.read.format("image").load(path).select("image.*")
    rows = rows.where(F.when(F.col("nChannels") > 0, True).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("origin", F.lit("?"))))))
    n = F.col("nChannels")
    wide = rows.select("origin", "nChannels", "data", "width", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))

    def byte(k) -> F.Column:
        return F.conv(F.hex(F.substr("data", F.col("i") * n + k + 1, F.lit(1))), 16, 10).cast("int")

    return wide.select(
        "origin",
        F.call_function("div", F.col("i"), F.col("width")).cast("int").alias("y"),
        (F.col("i") % F.col("width")).cast("int").alias("x"),
        byte(F.least(n - 1, F.lit(2))).alias("r"),
        byte(F.least(n - 1, F.lit(1))).alias("g"),
        byte(F.lit(0)).alias("b"),
        F.when(n == 4, byte(F.lit(3))).otherwise(255).alias("a"),
    )


def invalid_images(spark: SparkSession, path: str) -> DataFrame:
    """origin of the files that aren't images."""
    return spark.read.format("image").load(path).select("image.origin", "image.nChannels").where("nChannels <= 0 or nChannels is null").select("origin")


def pattern(spark: SparkSession, kind: str, width: int, height: int, cell: int = 8, image_id: int = 0) -> DataFrame:
    """A test image: checker, columns, rows, hue (a gradient round the colour wheel) or target (rings)."""
    i = F.col("id")
    df = spark.range(width * height).select(F.lit(image_id).alias("image_id"), F.call_function("div", i, F.lit(width)).cast("int").alias("y"), (i % width).cast("int").alias("x"))
    cx, cy = F.call_function("div", F.col("x"), F.lit(cell)), F.call_function("div", F.col("y"), F.lit(cell))
    if kind == "hue":
        turn = F.call_function("div", F.col("x") * 1536, F.lit(width))
        ramp = lambda at: F.greatest(F.lit(0), F.least(F.lit(255), F.abs(F.pmod(turn + at, F.lit(1536)) - 768) - 256))
        return df.select("image_id", "y", "x", ramp(0).cast("int").alias("r"), ramp(1024).cast("int").alias("g"), ramp(512).cast("int").alias("b"), F.lit(255).alias("a"))
    if kind == "target":
        dx, dy = F.col("x") * 2 + 1 - width, F.col("y") * 2 + 1 - height
        on = F.floor(F.sqrt(dx * dx + dy * dy) / (2 * cell)) % 2 == 0
    else:
        on = {"checker": (cx + cy) % 2 == 0, "columns": cx % 2 == 0, "rows": cy % 2 == 0}[kind]
    v = F.when(on, 255).otherwise(0)
    return df.select("image_id", "y", "x", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


def dense_rows(df: DataFrame, width: int) -> DataFrame:
    """image_id, y and the bytes of each line (4 a pixel); absent pixels are zero."""
    cell = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgba"))
    lines = df.where(F.col("x").between(0, width - 1)).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("v")))).alias("m"))

    def with_gap(p: F.Column, i: F.Column) -> F.Column:
        """A pixel behind the zeros of the gap before it."""
        before = F.when(i > 0, F.col("m")[F.greatest(i - 1, F.lit(0))]["x"]).otherwise(-1)
        return F.concat(F.repeat(F.lit("00000000"), p["x"] - before - 1), p["v"])

    text = F.rpad(F.array_join(F.transform("m", with_gap), ""), 8 * width, "0")
    return lines.select("image_id", "y", F.unhex(text).alias("data"))


def from_native(lines: DataFrame, fmt: str, width: int) -> DataFrame:
    """Pixels of lines (image_id, y, data) that hold a format's bytes; an indexed format gives its indices in idx."""
    f = formats.lookup(fmt)
    x = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    wide = lines.select("image_id", "y", "data", x.alias("x"))
    if f.packed:
        code = formats.read_pixel(F.col("data"), F.col("x"), fmt)
    else:
        size = f.bits // 8
        code = F.conv(F.hex(F.substr("data", F.col("x") * size + 1, F.lit(size))), 16, 10).cast("long")
        if f.bits == 32:
            code = F.when(code >= 1 << 31, code - (1 << 32)).otherwise(code)
        code = code.cast("int")
    out = wide.select("image_id", "y", "x", code.alias("code")).where("code is not null")
    if f.indexed:
        return out.withColumnRenamed("code", "idx")
    return formats.decode(out, fmt).select(*COLUMNS)


def to_native(df: DataFrame, fmt: str, width: int) -> DataFrame:
    """Lines (image_id, y, data) of a format of whole bytes; absent pixels are zero bytes."""
    size = formats.lookup(fmt).bits // 8
    cell = F.lpad(F.right(F.hex(F.col("code").cast("long")), F.lit(2 * size)), 2 * size, "0")
    lines = formats.encode(df, fmt).where(F.col("x").between(0, width - 1)).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("v")))).alias("m"))
    gap = lambda p, i: F.concat(F.repeat(F.lit("00" * size), p["x"] - F.when(i > 0, F.col("m")[F.greatest(i - 1, F.lit(0))]["x"]).otherwise(-1) - 1), p["v"])
    return lines.select("image_id", "y", F.unhex(F.rpad(F.array_join(F.transform("m", gap), ""), 2 * size * width, "0")).alias("data"))


def dense_tile(df: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """Every cell of a rectangle of each image, zero where no pixel is."""
    x0, y0, x1, y1 = rect
    rows = df.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(y0), F.lit(y1 - 1)))).withColumn("x", F.explode(F.sequence(F.lit(x0), F.lit(x1 - 1))))
    return rows.join(df.select(*COLUMNS), ["image_id", "y", "x"], "left").select("image_id", "y", "x", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"))


def png_bytes(rows: dict[int, bytes], width: int, height: int) -> bytes:
    """A PNG of RGBA lines by y."""

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    blank = bytes(4 * width)
    raw = b"".join(b"\0" + rows.get(y, blank) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_png(df: DataFrame, width: int, height: int) -> DataFrame:
    """image_id and png of each image; an image's lines are one group, which the image's size bounds."""

    def one(lines: pd.DataFrame) -> pd.DataFrame:
        data = png_bytes(dict(zip(lines["y"], lines["data"], strict=True)), width, height)
        return pd.DataFrame({"image_id": [lines["image_id"].iloc[0]], "png": [data]})

    return dense_rows(df, width).groupBy("image_id").applyInPandas(one, "image_id int, png binary")
