import itertools
import random
import zlib

import numpy as np

from tesserae.llm import sharding


def test_differencing_textbook():
    way = sharding.differencing(np.array([8, 7, 6, 5, 4]), 2)
    sums = [int(np.array([8, 7, 6, 5, 4])[way == k].sum()) for k in range(2)]
    assert sorted(sums) == [14, 16]


def test_differencing_near_the_best():
    rng = random.Random(2)
    for _ in range(20):
        w = np.array([rng.randint(1, 40) for _ in range(8)])
        best = min(max(sum(x for x, k in zip(w, c, strict=True) if k == j) for j in range(3)) for c in itertools.product(range(3), repeat=8))
        way = sharding.differencing(w, 3)
        assert max(w[way == j].sum() for j in range(3)) <= best * 1.25 + 1


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(sharding, "CLASSES", 8)
    monkeypatch.setattr(sharding, "TOP_ITEMS", 30)
    monkeypatch.setattr(sharding, "CHANGE", 10)
    rng = random.Random(4)
    texts = [None, None, "", "é" * 9000] + ["copy " * 200] * 120 + ["w" * rng.randint(1, 900) + str(i) for i in range(280)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(5, "copy " * 200, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, key string")
    out = sharding.shard_documents(spark, df, 16).collect()
    assert len(out) == len(rows)
    text_of = dict(enumerate(texts))
    place = {}
    for r in out:
        t = text_of[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert place.setdefault(t, r.shard) == r.shard
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    sums = sharding.shard_sums(((r.shard, r["size"]) for r in out), 16)
    giant = place["copy " * 200]
    others = [x for s, x in enumerate(sums) if s != giant]
    assert max(others) - min(others) < 18_000
    assert sharding.shard_documents(spark, df.limit(0), 16).count() == 0


def test_query_by_brute_force(spark):
    """Sizes, checksums, groups and gapless slots of the query by hand; its balance against differencing of all groups in one heap."""
    from tesserae.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op6_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    weights, shard_of = {}, {}
    for r in out:
        t = texts[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()), "bytes", None)
        assert shard_of.setdefault(t, r.shard) == r.shard
        weights[t] = weights.get(t, 0) + r["size"]
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    w = np.array(list(weights.values()))
    way = sharding.differencing(w, 16)
    best = [int(w[way == k].sum()) for k in range(16)]
    sums = sharding.shard_sums(((r.shard, r["size"]) for r in out), 16)
    assert max(sums) - min(sums) <= max(best) - min(best) + 16 * 16


def test_one_text_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 8)
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(300)] + [(2000 + i, None) for i in range(300)]
    out = sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]
    assert len({r.shard for r in out if r.doc_id < 1000}) == 1 and len({r.shard for r in out if r.doc_id >= 2000}) == 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
