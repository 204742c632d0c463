"""Aggregates over work logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_metrics(log: DataFrame, node: str, time: str, requested: str, used: str, size: str, label: str) -> DataFrame:
    """Calls, time, pixels, the largest allocation with its label, and ratios, by node; ratios with nothing below are 1 and 0."""
    sums = log.groupBy(node).agg(
        F.count("*").alias("calls"),
        F.sum(time).alias("time_sum"),
        F.sum(requested).alias("requested"),
        F.sum(used).alias("used"),
        F.max(F.struct(F.col(size), F.col(label))).alias("_m"),
    )
    ratio = F.when(F.col("requested") > 0, F.col("used") / F.col("requested")).otherwise(F.lit(1.0))
    return sums.select(node, "calls", "time_sum", "requested", "used", F.col(f"_m.{size}").alias("largest"), F.col(f"_m.{label}").alias("largest_label"), ratio.alias("efficiency"), (1 - ratio).alias("waste"))


def format_cube(log: DataFrame, fmt: str, op: str, pixels: str) -> DataFrame:
    """Calls and pixels by format and operation, with totals of each and of all."""
    return log.cube(fmt, op).agg(F.count("*").alias("calls"), F.sum(pixels).alias("pixels"), F.grouping_id().cast("int").alias("level"))


def alpha_histogram(df: DataFrame, step: int = 32) -> DataFrame:
    return df.groupBy(F.call_function("div", F.col("a"), F.lit(step)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def running_peak(log: DataFrame, group: str, order: list[str], change: str) -> DataFrame:
    """The highest running sum of changes in each group."""
    sums = log.withColumn("_now", F.sum(change).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return sums.groupBy(group).agg(F.max("_now").alias("peak"), F.sum(change).alias("final"))


def split_estimate(log: DataFrame, node: str, least: str, requested: str) -> DataFrame:
    """By node, what splitting could reach: the least pixels needed over those requested; 1 where nothing was requested."""
    sums = log.groupBy(node).agg(F.sum(least).alias("least"), F.sum(requested).alias("requested"))
    return sums.withColumn("split", F.when(F.col("requested") > 0, F.col("least") / F.col("requested")).otherwise(F.lit(1.0)))


def pool_counters(log: DataFrame, group: str, order: list[str], blocks: int) -> DataFrame:
    """Of a pool of so many blocks, taken (+1) and given back (-1) in order: hits, misses (taken when all were in use) and the peak in use.

    A miss takes no block, and what it would have taken is given back elsewhere: use beyond the pool counts as missed.
    """
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = log.withColumn("_now", F.sum("change").over(w))
    took = F.col("change") > 0
    return used.groupBy(group).agg(
        F.count_if(took & (F.col("_now") <= blocks)).alias("hits"),
        F.count_if(took & (F.col("_now") > blocks)).alias("misses"),
        F.least(F.max("_now"), F.lit(blocks).cast("long")).alias("peak"),
    )
