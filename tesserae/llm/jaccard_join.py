"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Two sets link when |x & y| / |x | y| >= 0.8, so they differ in at most H = (|x| + |y|) / 9 members.

1. Equal sets are one class, named by a 64-bit hash of the set; each class goes on as one set.
2. A set can only link if at most a fifth of its members stand in no other set. Members in the
   first COUNTED_PART of the hash space are counted over the whole corpus; a class with too many lone ones
   among them is dropped. This loses no link and leaves few sets in most corpora.
3. Sizes fall into bands (ratio 1.25). A band splits the universe of members into m > H segments by
   hash. Each set indexes the subset it has in each segment of its band, and, in a fixed tenth of the
   segments, that subset with each one member deleted. Against its own band and the band below, each
   set probes: a segment is worth one error if it is looked up exactly and two if its one-deletion
   neighbours are looked up too. Segments are taken by cost, large subsets first (they are rare),
   until they are worth H + 1; the rest, small or empty and so common, are not probed. By the
   pigeonhole a linked pair shares a key that one side probes and the other indexes.
4. Candidates are verified exactly on the sorted hashes of whole sets. As only connected components
   are asked for, a key with many sets doesn't need all its pairs: each set is first
   verified against one partner, twice (the one that most sets share keys with, which in a group of
   copies is one of the least changed); then keys whose sets are already in one component are done,
   and all untested pairs across components that share a key are verified, less those whose sketches
   (parities of hash classes) differ in more bits than a link allows. A key with more than CELL_ROWS sets is
   spread over a grid of cells, so no task compares more than CELL_ROWS with CELL_ROWS.
5. Rows with the same id are one document: the classes of its texts are joined before the components get their
   smallest ids.

Members are 64-bit hashes of shingles; within a pair of sets a false match has a chance of some 2^-40.

Defined results: A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`; a text of fewer than 5 words is
one shingle; a null or empty text has no shingles, links with nothing and is its own component (that of its id, if
another row has the same id); n_shingles is each row's own; ids are of any type with an order, strings in theirs; a row without an id
links, but names no component: its component_id is null if no linked row has an id; very long texts are
hashed piece by piece, whole; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tesserae.llm.common import SPACE, Scratch, lean, mix, small_batches, texts_of, word_blocks

SHINGLE = 5
#: Links need 100 * intersection >= NUMERATOR * union; sets of sizes s and t then differ in at most (s + t) // NINTH members.
NUMERATOR, NINTH = 80, 9
BAND_RATIO = 1.25
#: The part of the hash space whose members are counted over the corpus. It has to be over a fifth.
COUNTED_PART = 0.28
#: One segment in so many also indexes one-deletion neighbours.
DELETION_EVERY = 10
#: Bits of a set's sketch.
SKETCH_BITS = 512
#: Sets of a key that are compared in one place with as many others.
CELL_ROWS = 2048
#: Bits of the filter of ids that keeps sets out of a shuffle; beyond its size it only lets more through.
MOST_FILTER_BITS = 1 << 28

_U = np.uint64
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def shingle_sets(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text; no words, no members."""
    for first, _, counts, _, _, h in word_blocks(texts, SPACE):
        n = len(h)
        whole = np.zeros(n, _U)  # the shingle that begins at each word
        for k in range(SHINGLE):
            whole[: max(0, n - k)] += h[k:] * _C[k]
        whole = mix(whole)
        at = 0
        for i, c in enumerate(counts.tolist()):
            if c >= SHINGLE:
                yield first + i, np.unique(whole[at : at + c - SHINGLE + 1])
            elif c:
                short = np.append(h[at : at + c] * _C[:c], _U(c))
                yield first + i, mix(np.add.reduce(short, keepdims=True, dtype=_U))
            else:
                yield first + i, np.zeros(0, _U)
            at += c


def set_hash(members: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    total = np.add.reduce(mix(members ^ _C[1]), dtype=_U) + _U(len(members))
    return int(mix(np.array([total], _U)).astype(np.int64)[0])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, a): a row for each counted member of a set."""
    limit, seen = _U(int(COUNTED_PART * 2**64)), set()
    for batch in batches:
        hs, keys, size = [], [], 0
        for _, members in shingle_sets(texts_of(batch.column(1))):
            if not len(members):
                continue
            key = set_hash(members)
            if key in seen:
                continue
            seen.add(key)
            part = members[: np.searchsorted(members, limit)]
            hs.append(part)
            keys.append(np.full(len(part), key, np.int64))
            size += len(part)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).astype(np.int64)), pa.array(np.concatenate(keys))], names=["h", "a"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id, and the size and hash of its set; the hash is null without members."""
    for batch in batches:
        size: list[int] = [0] * batch.num_rows
        cls: list[int | None] = [None] * batch.num_rows
        for row, members in shingle_sets(texts_of(batch.column(1))):
            if len(members):
                size[row], cls[row] = len(members), set_hash(members)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64())], names=["id", "n", "cls"])


# --- bands, segments and keys ---------------------------------------------------------------


def band_of(size: np.ndarray | int) -> np.ndarray:
    """The band of a set size: band k holds sizes in (BAND_RATIO^(k-1), BAND_RATIO^k]."""
    return np.ceil(np.log(np.maximum(size, 1)) / np.log(BAND_RATIO) - 1e-9).astype(np.int64)


def band_top(band: int) -> int:
    top = int(BAND_RATIO**band + 1e-6)
    return max(1, top)


def segments_of(band: int) -> int:
    """Segments of a band: more than any error bound between a set of the band and a larger partner."""
    top = band_top(band)
    return (top + top * 100 // NUMERATOR) // NINTH + 1


def allocate(members: np.ndarray, band: int, partner_top: int) -> tuple[np.ndarray, ...]:
    """A set's segments in a band, and which of them it probes for partners of at most partner_top members.

    Returns keys of whole subsets, their flags (2: probed), the segments that have one-deletion
    neighbours and those where they are probed, each member's segment and hash, and each segment's
    sum, name and size.
    """
    m = segments_of(band)
    salt = np.array([band + 1], _U) * _C[2:4]
    mixed = mix(members ^ salt[0])
    segment = ((mixed >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, mixed = segment[order], mixed[order]
    counts = np.bincount(segment, minlength=m)
    prefix = np.zeros(len(mixed) + 1, _U)
    np.cumsum(mixed, dtype=_U, out=prefix[1:])
    ends = np.cumsum(counts)
    sums = prefix[ends] - prefix[ends - counts]
    names = mix(np.arange(m, dtype=_U) * _C[4] + salt[1])
    exact = mix(sums ^ names)
    with_deletions = np.arange(m) % DELETION_EVERY == 0
    need = (len(members) + partner_top) // NINTH + 1
    probe_deletions = with_deletions & (counts >= 3)
    worth = np.where(probe_deletions, 2, 1)
    rank = np.lexsort((-counts, ~probe_deletions))  # two for one first, then the larger subsets
    chosen = np.zeros(m, bool)
    chosen[rank[: int(np.searchsorted(np.cumsum(worth[rank]), need)) + 1]] = True
    probe_deletions &= chosen
    flags = np.where(chosen, 2, 0).astype(np.int8)
    return exact, flags, with_deletions, probe_deletions, segment, mixed, sums, names, counts


def set_keys(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a set with their flags: its own band's index and probes, and probes of the band below."""
    n = len(members)
    own = int(band_of(n))
    keys, flags = [], []
    for band in (own, own - 1):
        if band < 0 or (band < own and band_top(band) * 100 < NUMERATOR * n):
            continue  # no set of that band is large enough to link
        index = band == own
        exact, flag, with_deletions, probe_deletions, segment, mixed, sums, names, counts = allocate(members, band, min(n, band_top(band)))
        flag |= np.int8(index)
        keep = flag > 0
        keys.append(exact[keep])
        flags.append(flag[keep])
        deleted = (with_deletions & (counts >= 2) if index else probe_deletions)[segment]
        at = segment[deleted]
        keys.append(mix((sums[at] - mixed[deleted]) ^ names[at]))
        flags.append((np.where(probe_deletions[at], 2, 0) | (1 if index else 0) | 4).astype(np.int8))
    return np.concatenate(keys), np.concatenate(flags)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, members = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at in range(0, len(ids), 200):
            ks, fs, ns = [], [], []
            for raw in members[at : at + 200]:
                k, f = set_keys(np.frombuffer(raw, _U))
                ks.append(k)
                fs.append(f)
                ns.append(len(k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ks).astype(np.int64)), pa.array(np.repeat(ids[at : at + 200], ns)), pa.array(np.concatenate(fs))], names=["key", "id", "flags"]
            )


# --- verification ---------------------------------------------------------------------------


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < NUMERATOR * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= NUMERATOR * (len(x) + len(y) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        good = np.array([linked(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(xs, ys, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["u", "v", "good"])


def verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, good) of pairs of ids."""
    first = pairs.join(sets.select(F.col("id").alias("u"), F.col("members").alias("x")), "u")
    both = first.join(sets.select(F.col("id").alias("v"), F.col("members").alias("y")), "v")
    return scratch.cut(both.select("u", "v", "x", "y").mapInArrow(lean(_verify), "u long, v long, good boolean"), "verified")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge; by hooking and pointer jumping."""
    both = scratch.cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    labels = scratch.cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        hooked = scratch.cut(labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("to")), "hooked")
        # a component whose member found a smaller one moves as a whole
        moved = scratch.cut(hooked.groupBy("component").agg(F.min("to").alias("m")), "moved")
        step = scratch.cut(hooked.join(moved, "component").select("node", F.least("to", "m").alias("via"), "component"), "step")
        up = step.select(F.col("node").alias("via"), F.col("via").alias("root"))
        new = scratch.cut(step.join(up, "via", "left").select("node", F.least("via", F.coalesce("root", "via")).alias("component"), F.col("component").alias("old")), "labels")
        changed = not new.where("component != old").isEmpty()
        scratch.drop(hooked, moved, step, labels)
        labels = new
        if not changed:
            found = labels.select("node", "component")
            found._scratch_path = labels._scratch_path
            return found


def slot_of(id_col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(bits))


def id_filter(spark: SparkSession, ids: DataFrame) -> tuple[int, object]:
    """The number of bits and the broadcast bytes of a filter that lets all ids pass, and few others: one bit by hash.

    It has at most MOST_FILTER_BITS. With more ids it lets more others through; an exact join has to follow.
    """
    count = ids.count()
    bits = 1 << 15
    while bits < min(count * 16, MOST_FILTER_BITS):
        bits *= 2
    at = slot_of(F.col("id"), bits)
    words = ids.select(F.shiftright(at, 15).alias("w"), F.pmod(at, F.lit(1 << 15)).alias("p")).groupBy("w").agg(F.bitmap_construct_agg("p").alias("bitmap"))
    passing = np.zeros(bits // 8, np.uint8)
    for r in words.toLocalIterator():
        passing[r["w"] * 4096 : (r["w"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return bits, spark.sparkContext.broadcast(passing)


def survivors(spark: SparkSession, documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) of every row, and (id, members) of the classes that can have links, by the class's hash."""
    kind = documents.schema["id"].dataType.simpleString()
    rows = scratch.cut(documents.mapInArrow(lean(_sizes), f"id {kind}, n long, cls long"), "rows")
    classes = scratch.cut(rows.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min("id").alias("some")), "classes")
    lone = documents.mapInArrow(lean(_members), "h long, a long").groupBy("h").agg(F.min("a").alias("a"), F.max("a").alias("z")).where("a = z")
    lone = scratch.cut(lone.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("lone")), "lone")
    scratch.release()
    kept = classes.join(lone, "cls", "left").where(F.coalesce("lone", F.lit(0)) * 100 <= F.col("n") * (100 - NUMERATOR))
    kept = scratch.cut(kept.select("cls", F.col("some").alias("id")), "kept")
    # one row of each class is enough: texts are hashed again only where the row's id may be that of a class
    bits, shared = id_filter(spark, kept)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            on = np.flatnonzero((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            found = [m for _, m in shingle_sets(texts_of(batch.column(1).take(pa.array(on)))) if len(m)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(m) for m in found], pa.int64()), pa.array([m.tobytes() for m in found], pa.binary())], names=["id", "members"])

    sets = documents.withColumn("at", slot_of(F.col("id"), bits)).mapInArrow(lean(members), "id long, members binary")
    sets = scratch.cut(sets.join(kept.select(F.col("cls").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "sets")
    scratch.drop(classes, lone, kept)
    scratch.release()
    return rows, sets


def named_classes(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) of every row, and (cls, component, least): the component of each class and its smallest id."""
    small_batches(spark)
    rows, sets = survivors(spark, docs, scratch)
    edges = class_links(sets, scratch)
    # an id with several texts joins their classes
    several = rows.where("id is not null and cls is not null").groupBy("id").agg(F.min("cls").alias("u"), F.max("cls").alias("z")).where("u != z")
    several = scratch.cut(several.select("id", "u"), "several")
    if not several.isEmpty():
        own = rows.where("cls is not null").join(several, "id").where("cls != u").select("u", F.col("cls").alias("v"))
        edges = scratch.cut(own if edges is None else edges.union(own), "edges")
    named = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("own"))
    if edges is None:
        named = named.select("cls", F.col("cls").alias("component"), F.col("own").alias("least"))
    else:
        labels = components(edges, scratch).select(F.col("node").alias("cls"), "component")
        named = scratch.cut(named.join(labels, "cls", "left").select("cls", "own", F.coalesce("component", "cls").alias("component")), "named")
        named = named.join(named.groupBy("component").agg(F.min("own").alias("least")), "component").select("cls", "component", "least")
    named = scratch.cut(named, "least")
    scratch.keep(rows, named)
    return rows, named


def _row_components(rows: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, least) of every row; a row without members belongs where another row with its id does."""
    empty, full = rows.where("cls is null"), rows.where("cls is not null").join(named, "cls").select("id", "n", "least")
    ids = scratch.cut(empty.where("id is not null").select("id").distinct(), "empty")
    elsewhere = scratch.cut(full.join(ids, "id", "left_semi").groupBy("id").agg(F.min("least").alias("least")), "elsewhere")
    return full.unionByName(empty.join(elsewhere, "id", "left").select("id", "n", F.coalesce("least", "id").alias("least")))


def jaccard_components(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    scratch = Scratch(spark, "jaccard")
    rows, named = named_classes(spark, documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), scratch)
    out = _row_components(rows, named, scratch)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def class_links(sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(u, v): links that join all classes of a component; None without any."""
    keys = sets.mapInArrow(lean(_keys), "key long, id long, flags byte")
    # keys that one set probes and another indexes; a row says which side(s) of a link its set can be on
    probe, exact = F.col("flags").bitwiseAND(2) > 0, F.col("flags").bitwiseAND(4) == 0
    per_key = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(probe).alias("probed"), F.max(exact).alias("exact"), F.count("*").alias("size"))
    per_key = scratch.cut(per_key.where("low != high and probed and exact").select("key", "size"), "shared-keys")
    shared = scratch.cut(keys.join(per_key, "key"), "shared")
    # sets that many others share keys with: copies with few changes, in the middle of their group
    degrees = scratch.cut(shared.groupBy("id").agg(F.sum("size").alias("degree")), "degrees")
    wide, shared = shared, scratch.cut(shared.drop("size").join(degrees, "id"), "ranked")
    scratch.drop(per_key, wide, degrees)
    scratch.release()
    # sets by their candidates: the partner with the most common keys first
    edges, tested, labels = None, None, None
    rounds = 0
    while True:
        rows = shared
        if labels is None:
            rows = rows.withColumn("component", F.col("id"))
        else:
            rows = rows.join(labels, rows["id"] == labels["node"], "left").select("key", "id", "flags", "degree", F.coalesce("component", "id").alias("component"))
        if rounds < 2:
            # one partner for each set: in each key the set of the highest degree, if it is in another component
            center = rows.groupBy("key").agg(F.max(F.struct("degree", "id", "component")).alias("c"), F.min("component").alias("first"), F.max("component").alias("last")).where("first != last")
            center = scratch.cut(center.select("key", F.col("c.id").alias("v"), F.col("c.component").alias("vc")), "centers")
            pairs = rows.join(center, "key").where("component != vc").groupBy(F.col("id").alias("u"), "v").agg(F.count("*").alias("common"))
            if tested is not None:
                pairs = pairs.join(tested, ["u", "v"], "left_anti")
            pairs = pairs.groupBy("u").agg(F.max(F.struct("common", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
        else:
            # what is left: every untested pair across components on which one side probes and not both are deletions
            pairs = across_components(rows, sets, scratch)
            if tested is not None:
                pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = scratch.cut(pairs, "pairs")
        rounds += 1
        if pairs.isEmpty():
            if rounds > 2:
                return edges
            rounds = 2
            continue
        checked = verify(pairs, sets, scratch)
        swapped = checked.select(F.col("v").alias("u"), F.col("u").alias("v"))
        tested_now = checked.select("u", "v").union(swapped)
        tested = scratch.cut(tested_now if tested is None else tested.union(tested_now), "tested")
        good = checked.where("good").select("u", "v")
        if good.isEmpty():
            if rounds > 2:
                return edges
            rounds = 2
            continue
        edges = scratch.cut(good if edges is None else edges.union(good), "edges")
        if rounds > 2:
            return edges
        labels = components(edges, scratch)
        scratch.release()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n and the parities of SKETCH_BITS hash classes of the members, as longs."""
    for batch in batches:
        n, words = [], []
        for raw in batch.column(1).to_pylist():
            members = np.frombuffer(raw, _U)
            odd = np.bincount((mix(members ^ _C[4]) % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
            n.append(len(members))
            words.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        columns = np.array(words, np.int64).reshape(len(n), -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(columns[:, k]) for k in range(columns.shape[1]))], names=["id", "n", *(f"s{k}" for k in range(columns.shape[1]))])


def across_components(rows: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u < v: pairs of sets that share a key across components, probed by one side and exact on one.

    Two sets can't differ in fewer members than their sketches differ in bits, so within the join a
    pair is left out if its sketches differ in more bits than a link allows. That keeps the many sets of
    a group of copies that lie just too far apart from becoming rows.
    """
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells")).where("low != high").select("key", "cells")
    rows = scratch.cut(rows.drop("degree").join(scratch.cut(several, "open-keys"), "key"), "open")
    longs = [f"s{k}" for k in range(SKETCH_BITS // 64)]
    sketch = scratch.cut(sets.mapInArrow(lean(_sketches), ", ".join(["id long", "n long", *(f"{c} long" for c in longs)])), "sketches")
    rows = scratch.cut(rows.join(sketch, "id"), "sketched")
    # a key with many sets is a grid: probes are dealt over its lines and repeated along them, the index over its columns
    own, every = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

    def side(flag: int, mark: str) -> DataFrame:
        chosen = rows.where(F.col("flags").bitwiseAND(flag) > 0)
        line, column = (own, every) if mark == "p" else (every, own)
        return chosen.select(F.col("key").alias(f"{mark}_key"), line.alias(f"{mark}_line"), column.alias(f"{mark}_column"), *(F.col(c).alias(f"{mark}_{c}") for c in ["id", "flags", "component", "n", *longs]))

    apart = sum((F.bit_count(F.col(f"p_{c}").bitwiseXOR(F.col(f"q_{c}"))) for c in longs), F.lit(0))
    can = (
        (F.col("p_component") != F.col("q_component"))
        & ((F.col("p_flags").bitwiseAND(4) == 0) | (F.col("q_flags").bitwiseAND(4) == 0))
        & (F.least("p_n", "q_n") * 100 >= F.greatest("p_n", "q_n") * NUMERATOR)
        & (apart * NINTH <= F.col("p_n") + F.col("q_n"))
    )
    met = (F.col("p_key") == F.col("q_key")) & (F.col("p_line") == F.col("q_line")) & (F.col("p_column") == F.col("q_column"))
    pairs = side(2, "p").join(side(1, "q"), met & can)
    return pairs.select(F.least("p_id", "q_id").alias("u"), F.greatest("p_id", "q_id").alias("v")).distinct()


@F.pandas_udf(LongType())
def class_of(texts: pd.Series) -> pd.Series:
    """The hash of each text's set; null without members."""
    out = pd.array([None] * len(texts), "Int64")
    for row, members in shingle_sets([None if t is None else t.encode() for t in texts]):
        if len(members):
            out[row] = set_hash(members)
    return pd.Series(out)


def keep_one(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with one row of each component: that of its smallest id, of several rows with it the one of the least text.

    Of linked rows none of which has an id the one of the least text stays; rows with neither an id nor words all stay.
    Only texts that may have to go are shuffled: the others pass a filter of their ids as they are read.
    """
    scratch = Scratch(spark, "keep-one")
    columns = documents.columns
    found, named = named_classes(spark, documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), scratch)
    # what the filter can't pass at once: ids that go, and ids with several rows
    decided = _row_components(found.where("id is not null"), named, scratch).groupBy("id").agg(F.min("least").alias("least"), F.count("*").alias("copies"))
    decided = scratch.cut(decided.where("id != least or copies > 1").select("id", (F.col("id") != F.col("least")).alias("goes")), "decided")
    bits, shared = id_filter(spark, decided)

    @F.pandas_udf("boolean")
    def hit(slot: pd.Series) -> pd.Series:
        at = slot.to_numpy()
        return pd.Series(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    def least(rows: DataFrame, key: str) -> DataFrame:
        """One row for each key: the aggregate keeps it as it goes, so many copies don't meet."""
        return rows.groupBy(key).agg(F.min_by("_row", F.struct("_text", F.xxhash64("_row"))).alias("_row")).select("_row")

    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    marked = rows.where("_id is not null").withColumn("_maybe", hit(slot_of(F.col("_id"), bits)))
    tested = marked.where("_maybe").join(decided, F.col("_id") == F.col("id"), "left")
    out = marked.where("not _maybe").select("_row").unionByName(tested.where("goes is null").select("_row")).unionByName(least(tested.where("not goes"), "_id"))
    if not found.where("id is null").isEmpty():
        without = rows.where("_id is null").withColumn("cls", class_of("_text")).join(named, "cls", "left")
        out = out.unionByName(without.where("cls is null").select("_row")).unionByName(least(without.where("cls is not null and least is null"), "component"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
