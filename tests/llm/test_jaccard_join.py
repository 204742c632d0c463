import random
import re

import numpy as np

from tesserae.llm import jaccard_join as j

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """By id: for each of its rows the set's size, and the smallest id reachable."""
    sets = [(i, shingles(t)) for i, t in docs]
    ids, parent = sorted({i for i, _ in sets}), {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for k, y in sets[a + 1 :]:
            common = len(x & y)
            if x and y and 100 * common >= 80 * (len(x) + len(y) - common):
                p, q = sorted((root(i), root(k)))
                parent[q] = p
    return {i: (sorted(len(x) for k, x in sets if k == i), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(2000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            base += passage
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 6])):  # chains of edits, some across the bound
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                at = rng.randrange(len(base))
                base[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [base[at], rng.choice(vocab)]])
            docs.append(base)
    rng.shuffle(docs)
    texts = [rng.choice([" ", "\n", " \t"]).join(d) for d in docs]
    texts[3] = texts[3].upper()
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE "), (5005, "one two")]


def run(spark, docs, kind="long"):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], f"doc_id {kind}, text string, a string, id int")
    out = {}
    for r in j.jaccard_components(spark, df).collect():
        sizes, component = out.setdefault(r.doc_id, ([], r.component_id))
        assert component == r.component_id
        sizes.append(r.n_shingles)
    return {i: (sorted(n), c) for i, (n, c) in out.items()}


def test_against_brute_force(spark):
    docs = corpus(1) + [(i + 100_000, t) for i, t in corpus(2)]
    got, want = run(spark, docs), brute(docs)
    assert got == want


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = (int(rng.integers(0, max(1, n // 6) + 1)) for _ in range(2))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        if not j.linked(x, y):
            continue
        small, large = sorted((x, y), key=len)
        (ks, fs), (kl, fl) = j.set_keys(small), j.set_keys(large)
        probed = {(int(k), int(f) & 4) for k, f in zip(kl, fl, strict=True) if f & 2}
        indexed = {(int(k), int(f) & 4) for k, f in zip(ks, fs, strict=True) if f & 1}
        assert any((k, 0) in indexed or ((k, 4) in indexed and not d) for k, d in probed)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(2, None)]) == {2: ([0], 2)}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(4, text, "x"), (2, text, "y"), (9, "other words", None), (7, None, None)], "doc_id long, text string, _kept string")
    assert sorted(r.doc_id for r in j.keep_one(spark, df).collect()) == [2, 7, 9]


def test_repeated_ids_and_any_type_of_id(spark):
    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    t, u = words(1, 60), words(2, 60)
    docs = [(2, t), (2, u), (5, t + " x"), (6, u + " y"), (8, None), (8, words(3, 30)), (1, words(3, 30) + " z"), (9, t), (9, t), (7, None), (7, None)]
    got = run(spark, docs)
    assert got == brute(docs) and got[6][1] == 2 and got[8][1] == 1 and got[9] == ([56, 56], 2) and got[7] == ([0, 0], 7)
    names = [(f"id {i}", x) for i, x in docs]
    assert run(spark, names, "string") == brute(names)


def test_hot_key_and_long_texts(spark, monkeypatch):
    """Sets that share a passage, too far apart to link, over a grid of small cells; a text of many blocks."""
    monkeypatch.setattr(j, "CELL_ROWS", 3)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    body = lambda k, n: " ".join(f"{k}b{i}" for i in range(n))
    docs = [(i, passage + " " + body(rng.randrange(12), rng.choice([4, 8, 12, 16]))) for i in range(80)]
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    docs += [(1000, long), (1001, long + " one more"), (1002, long[: len(long) // 2])]
    assert run(spark, docs) == brute(docs)


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{k}w{i}" for i in range(40)) for k in "abc")
    rows = [(3, a, 1), (3, a, 1), (3, a, 1), (4, a + " x", 2), (None, a, 3), (None, b, 4), (None, b + " y", 5), (None, None, 6), (None, None, 6), (7, None, 7), (7, None, 7), (8, "", 8), (9, c, 9), (9, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumn("least", j.F.lit("l")).withColumn("id", j.F.lit(1.5))
    out = j.keep_one(spark, df.repartition(3))
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r["_row"]) for r in out.collect()), key=repr)
    assert kept == sorted([(3, 1), (None, 4), (None, 6), (None, 6), (7, 7), (8, 8)], key=repr)
