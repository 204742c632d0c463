import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:  # ids are unique here but for those that no query shares
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)[:k]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(700)] + [(9000, rows[3][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [nan] * 16), (3300, [inf] + [1.0] * 15), (3400, [None] + [1.0] * 15), (3500, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, id int").repartition(3)
    got = {}
    for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = brute(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        assert sorted(got[q]) == list(range(1, 11))
        assert [got[q][k] for k in sorted(got[q])] == sorted(got[q].values())
    assert [got[9000][k][1] for k in range(1, 11)] == [3, *range(2000, 2009)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 5.0])], "vec_id long, embedding array<float>")
    out = ann.nearest_neighbours(spark, df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 1.0), (0, 2, 2, 26**0.5)]
    assert ann.nearest_neighbours(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def recall(spark, x, **options):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = np.asarray(x, np.float32).astype(float)
    found = {}
    for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 50 == 0, **options).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in range(0, len(x), 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[:10]
        hits, total = hits + len(found[q] & set(near.tolist())), total + 10
    return hits / total


def test_recall_of_the_approximation(spark, monkeypatch):
    """Several cells, and units from which far fewer rows are measured exactly than they hold."""
    monkeypatch.setattr(ann, "UNIT_ROWS", 400)
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(5000, 32))
    assert recall(spark, flat / np.linalg.norm(flat, axis=1, keepdims=True), rerank=40) >= 0.9
    groups = rng.normal(size=(60, 32))[rng.integers(0, 60, 5000)] + 0.3 * rng.normal(size=(5000, 32))
    assert recall(spark, groups, rerank=40) >= 0.9
    made = ann.Index.fit(groups, len(groups))
    cells = made.coarse.books.shape[1] ** 2
    assert cells >= 9 and made.probes <= cells // 2  # structure is used


def test_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(100, a), (100, b), (100, a), (1, a), (2, b), (3, c), (3, c), (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest_neighbours(spark, df, F.col("vec_id") % 100 == 0, k=3).collect()
    lists = sorted([r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if round(r.score, 6) in own] for own in ({0.0, 0.141421}, {0.0}))
    assert len(out) == 6 and sorted(r["rank"] for r in out) == [1, 1, 2, 2, 3, 3]
    assert sorted(r.vec_id for r in out) == [1, 2, 3, 3, 3, 3] and lists


def test_one_id_in_many_rows(spark, monkeypatch):
    """An id with more rows near its own query than any list holds doesn't hide the others."""
    monkeypatch.setattr(ann, "UNIT_ROWS", 64)
    rng = np.random.default_rng(2)
    near = [[float(v) for v in 1 + 1e-3 * rng.normal(size=8)] for _ in range(300)]
    rows = [(100, v) for v in near] + [(i, [float(v) for v in 1 + rng.normal(size=8)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest_neighbours(spark, df, F.col("vec_id") % 100 == 0, k=3, rerank=512).collect()
    assert len(out) == 900 and 100 not in {r.vec_id for r in out}


def test_strings_as_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.5, 0.0])], "vec_id string, embedding array<double>")
    out = ann.nearest_neighbours(spark, df, F.col("vec_id") == "a", k=2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [("a", "c", 0.5), ("a", "b", 1.0)]


def hard_rows(kind, rng, n=1200, dim=16):
    x = rng.normal(size=(n, dim))
    if kind == "far from zero":
        x += 1000
    elif kind == "of very different lengths":
        x *= np.exp(3 * rng.normal(size=(n, 1)))
    elif kind == "in tight groups":
        x = rng.normal(size=(3, dim))[rng.integers(0, 3, n)] + 1e-3 * x
    elif kind == "large":
        x *= 1e20
    elif kind == "small":
        x *= 1e-25
    elif kind == "in a small far group":
        x[::20] = 30 + 0.01 * x[::20]
    elif kind == "on a grid":
        x = np.eye(dim)[rng.integers(0, dim, n)] * rng.integers(1, 40, (n, 1))
    elif kind == "beyond double precision":
        x *= 10.0 ** rng.choice([-170, 0, 170], size=(n, 1))
    return x if kind == "beyond double precision" else x.astype(np.float32)


def lists(spark, x, element="float", **options):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{element}>").repartition(3)
    got = {}
    for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 50 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    return {q: [found[k] for k in sorted(found)] for q, found in got.items()}


def all_lists(x):
    out = {}
    x = np.asarray(x, float)
    for q in range(0, len(x), 50):
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[q] = [(float(d[i]), int(i)) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
    return out


KINDS = ["far from zero", "of very different lengths", "in tight groups", "large", "small", "in a small far group", "on a grid", "beyond double precision"]


@pytest.mark.parametrize("kind", KINDS)
def test_no_neighbour_is_missed(spark, monkeypatch, kind):
    """Rows whose scores or cells say little: the lists are those of brute force, ties included."""
    monkeypatch.setattr(ann, "UNIT_ROWS", 300)
    x = hard_rows(kind, np.random.default_rng(3))
    assert lists(spark, x, "double" if kind.startswith("beyond") else "float", rerank=20) == all_lists(x)


def test_second_pass_finds_what_the_first_cell_lacks(spark, monkeypatch):
    monkeypatch.setattr(ann, "UNIT_ROWS", 100)
    monkeypatch.setattr(ann.Index, "_measured", lambda *_: 1)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(1000, 8)), rng.normal(size=(12, 8))[rng.integers(0, 12, 1000)] + 0.2 * rng.normal(size=(1000, 8))):
        x = x.astype(np.float32)
        assert lists(spark, x, rerank=20) == all_lists(x)


def test_cells_too_far_are_left_out():
    rng = np.random.default_rng(5)
    x = 10 * rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] + 0.01 * rng.normal(size=(3000, 8))
    made = ann.Index.fit(x, 3000 * ann.UNIT_ROWS // 100)
    cells, far = made.cells(made.put(x))
    radii = np.full(made.coarse.books.shape[1] ** 2, -1.0)
    np.maximum.at(radii, cells, far)
    limits = np.array([np.sort(np.sqrt(((x - q) ** 2).sum(axis=1)))[11] for q in x[:50]])
    may = made.may_hold(made.put(x[:50]), limits, radii) & (radii >= 0)
    for q, limit, row in zip(x[:50], limits, may, strict=True):
        assert row[cells[np.sqrt(((x - q) ** 2).sum(axis=1)) <= limit]].all()
    assert may.sum(axis=1).mean() <= (radii >= 0).sum() / 2


def test_one_id_in_many_rows_does_not_fill_the_candidates(spark):
    rng = np.random.default_rng(6)
    rows = [(100, [float(v) for v in 1 + 1e-3 * rng.normal(size=8)]) for _ in range(300)]
    rows += [(i, [float(v) for v in 1 + rng.normal(size=8)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 100 == 0, k=3).collect():
        got.setdefault(r["rank"], []).append((r.score, r.vec_id))
    x = np.array([v for _, v in rows])
    want = [sorted((float(d), i) for d, (i, _) in zip(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), rows, strict=True) if i != 100)[:3] for q in range(300)]
    assert {n: sorted(found) for n, found in got.items()} == {n: sorted(w[n - 1] for w in want) for n in (1, 2, 3)}


@pytest.mark.parametrize("probes", [1, 100])
def test_repeated_ids_and_vectors_in_many_cells(spark, monkeypatch, probes):
    monkeypatch.setattr(ann, "UNIT_ROWS", 30)
    monkeypatch.setattr(ann.Index, "_measured", lambda *_: probes)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(rng.integers(0, 120, 700), rng.integers(1, 6, (700, 3)), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r.query_id, r["rank"], r.score, r.vec_id) for r in ann.nearest_neighbours(spark, df, F.col("vec_id") % 20 == 0, k=4, rerank=6).collect()]
    want, x = [], np.array([v for _, v in rows])
    for q, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        near = sorted((float(d), i) for d, (i, _) in zip(np.sqrt(((x - v) ** 2).sum(axis=1)), rows, strict=True) if i != q)[:4]
        want += [(q, n, d, i) for n, (d, i) in enumerate(near, 1)]
    assert sorted(got) == sorted(want)
