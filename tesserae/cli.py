"""Filters over image files: python -m tesserae.cli in.png -o folder --brightness 0.2 --blur 3 --grayscale --alpha 0.5"""

from __future__ import annotations

import argparse
import os
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.functions import pixels
from tesserae.operators import blur
from tesserae.sources import images


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Filters over image files.")
    parser.add_argument("path", help="an image file or a folder of them")
    parser.add_argument("-o", "--output", required=True, help="a folder for PNG files")
    parser.add_argument("--brightness", type=float)
    parser.add_argument("--grayscale", action="store_true")
    parser.add_argument("--blur", type=int, help="radius of a box blur along both axes")
    parser.add_argument("--alpha", type=float)
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    df = images.read_images(spark, given.path)
    sizes = df.groupBy("origin").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    os.makedirs(given.output, exist_ok=True)
    found = sizes.orderBy("origin").collect()
    names = Counter(stem(r["origin"]) for r in found)
    for n, r in enumerate(found):  # files come one by one, each as a job
        one = df.where(F.col("origin") == r["origin"]).withColumn("image_id", F.lit(n))
        if given.brightness is not None:
            one = pixels.brightness(one, given.brightness)
        if given.grayscale:
            one = pixels.grayscale(one)
        if given.blur:
            one = blur.blur_2d(one, given.blur).where(F.col("x").between(0, r["w"] - 1) & F.col("y").between(0, r["h"] - 1))
        if given.alpha is not None:
            one = pixels.alpha_scale(one, given.alpha)
        name = stem(r["origin"])
        if names[name] > 1:  # files of one name in several folders, or of several kinds
            name = f"{name}-{n}"
        for row in images.encode_png(one, r["w"], r["h"]).collect():
            with open(os.path.join(given.output, f"{name}.png"), "wb") as f:
                f.write(row["png"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
