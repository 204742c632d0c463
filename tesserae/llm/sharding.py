"""Sharding by Karmarkar-Karp differencing over groups that mustn't be divided.

Documents with equal texts form a group. Differencing keeps partial partitions (one sum for each
shard) and repeatedly combines the two with the largest spread, the largest sums of one with the
smallest of the other, until one is left. All groups can't be in one heap, so it runs in levels:
groups are dealt by hash into blocks of about BLOCK_ITEMS; each block's heap splits its groups
into CLASSES near-equal bundles; bundles are dealt again while there are more than TOP_ITEMS;
the last heap, on the driver, is of bounded size. Groups heavier than a small part of a shard
skip the blocks, so that bundles can balance them, and so does a thin slice of all groups (by
hash), which gives the last heap small change.

Slots are gapless without sorting a whole shard in one task: rows are dealt by the hash of their
ids into cells, ranked in each cell, and shifted by the counts of the cells before.

A text that a large part of all rows has (HOT) is one key: the few such keys are joined by a broadcast of at most HOT
rows, all others by a shuffle.

Defined results: a null text has size 1 and a null checksum, and all null texts are one group;
an empty text has size 1; a very long text is a group as any other, never divided; documents with equal ids are each placed, in any order among
equals; fewer groups than shards leave shards empty; an empty table gives no rows; other
columns aren't looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch

BLOCK_ITEMS = 8192
CLASSES = 128
TOP_ITEMS = 65_536
#: A group over 1/HEAVY of the shard's fair share goes to the last heap by itself: at most shards * HEAVY groups.
HEAVY = 256
#: A group with over 1/HOT of all rows is joined by broadcast: at most HOT groups.
HOT = 4096
#: About so many groups, whatever their size, are kept as small change.
CHANGE = 4096


def differencing(weights: np.ndarray, ways: int) -> np.ndarray:
    """The way (0 to ways - 1) of each item by Karmarkar-Karp differencing."""
    n = len(weights)
    if not n:
        return np.zeros(0, np.int64)
    # a partial partition: its sums in ascending order, and for each sum the node that holds its items
    children: list[tuple[int, int]] = [(-1, -1)] * n  # leaves; node -1 holds nothing
    heap: list[tuple] = []
    for i in np.argsort(-weights, kind="stable").tolist():
        sums, nodes = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[-1], nodes[-1] = weights[i], i
        heap.append((-int(weights[i]), i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s2, n2 = s2[::-1], n2[::-1]
        sums, nodes = s1 + s2, np.where(n1 < 0, n2, n1)
        for at in np.flatnonzero((n1 >= 0) & (n2 >= 0)).tolist():
            nodes[at] = len(children)
            children.append((int(n1[at]), int(n2[at])))
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = sums[0]
        heapq.heappush(heap, (-int(sums[-1] - low), serial, sums, nodes))
        serial += 1
    way = np.zeros(len(children), np.int64)
    for w, node in enumerate(heap[0][3].tolist()):
        if node >= 0:
            way[node] = w
    for node in range(len(children) - 1, n - 1, -1):  # a node comes after its children
        for child in children[node]:
            way[child] = way[node]
    return way[:n]


def assign_groups(spark: SparkSession, groups: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(key, shard) of each group; groups: key (any type), weight (long). One row a key."""
    items = scratch.cut(groups.select(F.xxhash64("key").alias("h"), "key", "weight"), "groups")
    n, total = items.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return items.select("key", F.lit(0).cast("long").alias("shard"))
    heavy = F.col("weight") * (shards * HEAVY) > total
    change = F.pmod(F.xxhash64(F.lit("change"), "h"), F.lit(max(1, n // CHANGE))) == 0
    level = items.withColumn("top", heavy | change)
    bundles = level.where("not top").select(F.col("h").alias("item"), F.col("key"), "weight")
    count, depth = n, 0
    maps: list[DataFrame] = []  # from an item of a level to the bundle that holds it
    while count > (TOP_ITEMS if maps else 0):
        blocks = max(1, -(-count // BLOCK_ITEMS))
        names = bundles.columns
        dealt = bundles.withColumn("block", F.pmod(F.xxhash64(F.lit(depth), "item"), F.lit(blocks))).repartition(blocks, "block")
        split = dealt.groupBy("block").applyInPandas(_block, ", ".join(f"{c} {t}" for c, t in bundles.dtypes) + ", bundle long")
        maps.append(scratch.cut(split.select(*names, "bundle"), "level"))
        bundles = scratch.cut(maps[-1].groupBy(F.col("bundle").alias("item")).agg(F.sum("weight").alias("weight")), "bundles")
        count, before = bundles.count(), count
        depth += 1
        if count >= before:
            break
    single = level.where("top").select("key", "weight").toPandas()
    last = bundles.select("item", "weight").toPandas()
    way = differencing(np.concatenate([single["weight"], last["weight"]]).astype(np.int64), shards)
    of_bundle = dict(zip(last["item"].tolist(), way[len(single) :].tolist(), strict=True))
    of_single = single.assign(shard=way[: len(single)])[["key", "shard"]]
    found = spark.createDataFrame(pd.DataFrame({"bundle": list(of_bundle), "shard": list(of_bundle.values())}, dtype="int64"), "bundle long, shard long")
    for k in range(len(maps) - 1, -1, -1):
        found = maps[k].join(F.broadcast(found) if k == len(maps) - 1 else found, "bundle").select(*(["key"] if k == 0 else [F.col("item").alias("bundle")]), "shard")
    kind = items.schema["key"].dataType.simpleString()
    return found.unionByName(spark.createDataFrame(of_single, f"key {kind}, shard long"))


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("item")
    way = differencing(frame["weight"].to_numpy(np.int64), CLASSES)
    return frame.drop(columns="block").assign(bundle=frame["block"].astype(np.int64) * CLASSES + way)


def shard_documents(spark: SparkSession, documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes and 1), text_crc32, shard, slot of every row; equal texts share a shard."""
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    rows = documents.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.encode(text, "UTF-8"))), F.lit(b"\0").cast("binary")).alias("key"),
    )
    rows = scratch.cut(rows, "rows")
    groups = scratch.cut(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("copies")), "texts")
    shard_of = scratch.cut(assign_groups(spark, groups.select("key", "weight"), shards, scratch), "shards")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = scratch.cut(groups.where(F.col("copies") * HOT > total).join(shard_of, "key").select("key", "shard"), "hot")
    few = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(shard_of, "key")
    many = rows.join(F.broadcast(hot), "key")
    placed = few.select("id", "size", "text_crc32", "shard").unionByName(many.select("id", "size", "text_crc32", "shard"))
    placed = scratch.cut(placed.withColumn("shard", F.col("shard").cast("int")), "placed")
    scratch.keep(placed)
    return place_in_slots(spark, placed).withColumnRenamed("id", id_col)


def place_in_slots(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, by cells of the ids' hashes."""
    cells = max(1, min(4096, placed.count() // 4096))  # a few thousand rows or more in each, and a bounded table of counts
    cell = F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")
    rows = placed.withColumn("cell", cell)
    counts = rows.groupBy("shard", "cell").count().toPandas().sort_values(["shard", "cell"])
    counts["before"] = counts.groupby("shard")["count"].cumsum() - counts["count"]
    before = spark.createDataFrame(counts[["shard", "cell", "before"]].reset_index(drop=True), "shard int, cell int, before long")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32")) - 1
    ranked = rows.withColumn("at", rank)
    return ranked.join(F.broadcast(before), ["shard", "cell"]).withColumn("slot", F.col("at") + F.col("before")).drop("cell", "at", "before")


def shard_sums(frame: Iterator[tuple[int, int]], shards: int) -> list[int]:
    """Bytes in each shard, from (shard, size) pairs."""
    out = [0] * shards
    for shard, size in frame:
        out[shard] += size
    return out
