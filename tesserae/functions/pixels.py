"""Filters of single pixels as column expressions, and a registry of them by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.fixed import single
from tesserae.operators import blur


def brightness(df: DataFrame, amount: float) -> DataFrame:
    """Adds amount * 255 (cut towards zero) to the colours, kept within 0..255."""
    add = math.trunc(single(single(amount) * 255))
    return df.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + add)) for c in "rgb"})


def grayscale(df: DataFrame) -> DataFrame:
    """The mean of the colours."""
    mean = F.expr("cast((r + g + b) div 3 as int)")
    return df.withColumns(dict.fromkeys("rgb", mean))


def alpha_scale(df: DataFrame, scale: float) -> DataFrame:
    """Alpha times scale in 1/256 steps, cut to a byte."""
    by = math.trunc(single(single(scale) * 256))
    return df.withColumn("a", F.shiftright(F.col("a") * by, 8).bitwiseAND(F.lit(255)))


def alpha_scale_premultiplied(df: DataFrame, scale: float) -> DataFrame:
    """All four 16-bit premultiplied channels times scale in 1/65536 steps."""
    by = math.trunc(single(single(scale) * 65536))
    return df.withColumns({c: F.shiftright(F.col(c).cast("long") * by, 16).cast("int") for c in "rgba"})


def color_key(df: DataFrame, key: tuple[int, int, int, int], replacement: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Pixels of exactly one colour become another."""
    if key == replacement:
        return df
    hit = (F.col("r") == key[0]) & (F.col("g") == key[1]) & (F.col("b") == key[2]) & (F.col("a") == key[3])
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in zip("rgba", replacement, strict=True)})


#: Filters by name; each takes a frame and its parameters.
FILTERS: dict[str, Callable[..., DataFrame]] = {"brightness": brightness, "grayscale": grayscale, "alpha": alpha_scale}


#: How far beyond its output a filter reads, by name, from its parameters.
MARGINS: dict[str, Callable[..., int]] = {}


def register(name: str, function: Callable[..., DataFrame], margin: Callable[..., int] | None = None) -> None:
    """Add a filter of one's own; margin says how many pixels beyond its output it reads."""
    FILTERS[name] = function
    MARGINS.pop(name, None)
    if margin is not None:
        MARGINS[name] = margin


def margin_of(name: str, *params: float) -> int:
    return MARGINS[name](*params) if name in MARGINS else 0


def apply_first(df: DataFrame, name: str, *params: float) -> DataFrame:
    """A first-generation filter by name, blur and boxblur (radius 3 unless given) among them; an unknown one passes pixels through."""
    given = lambda default: params[0] if params else default
    if name in ("blur", "boxblur"):
        return blur.mean_blur(df, int(given(3.0)))
    if name in ("brightness", "alpha"):
        return apply(df, name, given(0.0 if name == "brightness" else 1.0))
    return grayscale(df) if name == "grayscale" else df


def apply(df: DataFrame, name: str, *params: float) -> DataFrame:
    """A filter by name; an unknown one passes pixels through."""
    return FILTERS[name](df, *params) if name in FILTERS else df
