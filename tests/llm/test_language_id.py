import random
import zlib

import numpy as np
import pytest

from tesserae.llm import language_id as li

PARTS = {"en": ["th", "ing", "the", "wh", "and"], "de": ["sch", "ein", "ung", "für", "ü"], "fr": ["eau", "oi", "é", "ç", "que"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600) + [(10_000, None, "en"), (10_001, "", "de"), (10_002, "12 !?", None), (10_003, "the and " * 60_000, None), (None, "the wh", "en")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    out = {r.doc_id: r for r in li.identify(spark, df).collect()}
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    assert len(held) > 90 and np.mean([out[i].lang_pred == y for i, _, y in held]) > 0.97
    assert [(out[i].lang_pred, out[i].score) for i in (10_000, 10_001, 10_002)] == [("und", 0.0)] * 3
    assert out[10_003].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    assert li.keep_known(spark, df).count() == len(rows) - 3


def test_ngrams_do_not_cross_texts():
    texts = ["ab c", None, "", "ñX", "\U0001d400!"]
    joined = "\n".join(t or "" for t in texts)
    row, feature, letters = li.ngrams(texts, joined)
    assert letters.tolist() == [3, 0, 0, 2, 1]
    for i, t in enumerate(texts):
        alone = li.ngrams([t], t or "")[1]
        assert sorted(feature[row == i]) == sorted(alone)


def test_weights_are_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows, labels = [], rng.integers(0, 2, 400)
    for y in labels:
        noise = rng.choice(np.arange(10, 500), 20, replace=False)
        rows.append((np.append(noise, y), np.append(np.full(20, 0.2), 1.0)))
    w, _ = li.fit_ftrl(rows, labels, 2, l1=1.0)
    assert np.count_nonzero(w) < 300 and w[0, 0] > 0 > w[0, 1]
    t = li.fit_temperature(np.array([[2.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3))
    assert np.exp(2 / t) / (1 + np.exp(2 / t)) == pytest.approx(0.7, abs=0.01)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.identify(spark, df).collect()] == [("und", 0.0)]
    assert li.identify(spark, df.limit(0)).count() == 0


def test_rare_language_and_clashing_columns(spark):
    rows = [(0, "zaz zaz ziz", "aa", 1)] + [(i, "mono momo nomo", "bb", i) for i in range(1, 60)] + [(7, "mono momo nomo", "bb", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _found int").withColumn("row", li.F.lit("r")).withColumn("found", li.F.lit(2))
    learn = li.train(spark, df, li.F.lit(True))
    assert learn.languages == ["aa", "bb"] and learn.predict(["zaz zaz ziz"])[0] == ["aa"]
    kept = li.keep_known(spark, df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_query_scores_by_brute_force(spark):
    """Predictions of the query equal the model's own weights applied to each whole text alone."""
    from tesserae.llm.common import table
    from tesserae.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = li.train(spark, docs, ~li.held_out())
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        _, feature, _ = li.ngrams([r.text], r.text)
        f, c = np.unique(feature, return_counts=True)
        logits = (c / c.sum()) @ model.weights[f].astype(np.float64) + model.bias
        p = np.exp((logits - logits.max()) / model.temperature)
        assert g.lang_pred == model.languages[int(p.argmax())] and abs(g.score - p.max() / p.sum()) < 1e-3
    held = [r for r in rows if got[r.doc_id].held_out and r.lang and got[r.doc_id].lang_pred != "und"]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
