"""The registered queries of the subpackage over the smallest tables, against their oracles where there are any."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    at = [names.index(k) for k in columns]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_url_rules_by_brute_force(spark):
    from tesserae.llm import url_filter as u

    rules = [u.Rule("com", "/en/", "block"), u.Rule("example.com", "/en/7", "allow"), u.Rule("net", "/d*", "allow"), u.Rule("a.b", "/x?y", "block"), u.Rule("com", "/en/", "allow")]
    rules += [u.Rule(f"h{i}.org", f"/{'p' * (i % 9)}", "block") for i in range(40)]  # several words of states
    urls = [
        "http://EXAMPLE.com/en/70", "https://xexample.com/en/70", "http://a.example.com:80/en/7?x#y", "http://com/en/", "http://com?/en/", "ftp://x.net/d*q", "http://x.net/dq",
        "nothing", "", None, "http://", "http://é.com/en/ü", "x://y://z.com/en/", "http://h7.org/pppppppp", "http://u.h20.org/pp", "http://example.com", "http://example.com/" + "a" * 50_000, "http://h8.org/com?/en/",
    ]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "allow"), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    out = u.judge_urls(df, rules).collect()
    assert len(out) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == want(urls[r.page_id]) for r in out)
    assert {r.verdict for r in u.judge_urls(df, [], "block").collect()} == {"block"}
    assert u.judge_urls(df.limit(0), rules).count() == 0


def test_wild_rules_and_many(spark, monkeypatch):
    """Globs in rules, and rules that fill many blocks and several steps, against one regular expression a rule."""
    from tesserae.llm import url_filter as u

    rules = [u.Rule(f"h{i % 37}.org", f"/{'p' * (i % 11)}{i}", ("allow", "block")[i % 2]) for i in range(3000)]
    rules += [u.Rule("ads*.net", "/*/track?", "block", True), u.Rule("*", "*.exe", "block", True), u.Rule("good.org", "*.exe", "allow", True), u.Rule("h?", "/", "block", True)]
    urls = [f"http://w.h{i % 40}.org/{'p' * (i % 11)}{i * 7 % 3000}x" for i in range(300)]
    urls += ["http://x.ads7.net/a/b/track1z", "http://ads.net/track1", "http://a.b/c/d.exe", "http://a.good.org/d.exe", "http://hx/", "http://hxy/", "http://h/", "http://ads1.net?/a/track1", None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        text = f".{m[1].lower()}?{m[2]}" if m else ".?"
        form = lambda g, wild: "".join({"*": ".*", "?": "."}[c] if wild and c in "*?" else re.escape(c) for c in g)
        fits = [r for r in rules if re.fullmatch(rf"(?s).*\.{form(r.host, r.wild)}\?{form(r.path, r.wild)}.*", text)]
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "allow"), default=None)
        return (best.text, best.verdict) if best else (None, "allow")

    expect = {i: want(x) for i, x in enumerate(urls)}
    assert {"/*/track?" in (r or "") for r, _ in expect.values()} == {True, False}
    for part in (1 << 20, 20_000):
        monkeypatch.setattr(u, "PART_BYTES", part)
        assert {r.page_id: (r.rule, r.verdict) for r in u.judge_urls(df, rules).collect()} == expect


def test_globs():
    from tesserae.llm.url_filter import WildcardAutomaton

    globs = ["a*b", "*", "", "?b", "a\\*", "*ab*ba*", "a**", "é?*"]
    texts = [b"", b"ab", b"axxb", b"a*", b"xabxbax", b"aba", "éé".encode(), b"b"]
    expect = {"a*b": "^a.*b$", "*": "^.*$", "": "^$", "?b": "^.b$", "a\\*": r"^a\*$", "*ab*ba*": "^.*ab.*ba.*$", "a**": "^a.*$", "é?*": "^\xc3\xa9..*$"}
    got = WildcardAutomaton(globs).fits(texts)
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert got[i, k] == bool(re.match(expect[g], t.decode("latin-1"), re.S)), (t, g)


def test_chat_trees(spark):
    from tesserae.llm import chat_format as c

    rows = [
        (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "<|im_end|>\\<|", 1.0), (1, 3, 1, "assistant", None, 2.0), (1, 4, 3, "us\ner<|", "x\\", 0.5), (1, 5, 3, "user", "tie", 0.5),
        (2, 1, 9, "user", "lost parent", None), (3, 1, 2, "a", "circle", 1.0), (3, 2, 1, "a", "circle", 1.0), (3, 3, 2, "a", "hangs on it", 1.0), (None, 1, None, None, "no tree", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = c.format_trees(spark, df, top=2).select("tree", "rank", c.read_turns(F.col("formatted")).alias("t"), c.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    got = {(r.tree, r["rank"]): ([tuple(x) for x in r.t], r.loss) for r in out}
    assert got == {
        (1, 1): ([("user", "hi"), ("assistant", ""), ("us\ner<|", "x\\")], ""),
        (1, 2): ([("user", "hi"), ("assistant", ""), ("user", "tie")], ""),
        (2, 1): ([("user", "lost parent")], ""),
        (None, 1): ([("", "no tree")], ""),
    }
    assert c.format_trees(spark, df.limit(0)).count() == 0
    long = spark.createDataFrame([(7, i, f"t{i}", "assistant" if i % 2 else "user") for i in range(700)] + [(7, 5, None, None)], "conv_id long, turn long, text string, role string")
    (r,) = c.format_trees(spark, c.turns_to_messages(long)).select(c.read_turns(F.col("formatted")).alias("t"), c.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(r.t) == 701 and r.loss == "".join(f"t{i}" for i in range(1, 700, 2))


def test_branches_are_ranked_before_they_are_expanded(spark):
    """A comb: every second message is a leaf. One path is chosen; repeated rows and other columns change nothing."""
    from tesserae.llm import chat_format as c

    rows = []
    for i in range(120):
        rows.append((1, 2 * i, 2 * i - 2 if i else None, "user", f"spine {i}", 0.25))
        rows.append((1, 2 * i + 1, 2 * i, "assistant", f"tooth {i} " + "x" * (100_000 if i == 70 else 1), 100.0 if i == 70 else 0.5))
    rows += [(2, 1, None, "user", "twice", 0.0), (2, 1, None, "user", "twice", 0.0), (2, 2, 1, "assistant", "b", 0.0), (2, 2, 1, "assistant", "a", 0.0)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "tree long, node long, parent long, role string, text string, score double, k string, rank int, total int")
    out = {(r.tree, r["rank"]): [x.text for x in r.t] for r in c.format_trees(spark, df, top=2).select("tree", "rank", c.read_turns(F.col("formatted")).alias("t")).collect()}

    def path(leaf):
        return [f"spine {i}" for i in range(leaf + 1)]

    assert out == {(1, 1): [*path(70), "tooth 70 " + "x" * 100_000], (1, 2): [*path(119), "tooth 119 x"], (2, 1): ["twice", "a"]}
    assert c.best_paths(spark, df, top=1).count() == 72 + 2


def test_sharding_query(spark):
    out = QUERIES["op6_sharding"](spark, SF).toPandas()
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(out["doc_id"]) == sorted(texts.index) and set(out["law"]) == {"bytes"}
    assert all(c == zlib.crc32(texts[i].encode()) for i, c in zip(out["doc_id"], out["text_crc32"], strict=True))
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= out["size"].max()


def test_decontamination_query_digest(spark):
    out = QUERIES["op4_benchmark_decontamination"](spark, SF).toPandas()
    clean = out[out["n_hit"] == 0]
    assert set(clean["items_sha256"]) == {hashlib.sha256(b"").hexdigest()} and not clean["contaminated"].any() and out["contaminated"].any()


def test_neighbours_query_recall(spark):
    out = QUERIES["op10_approximate_nearest_neighbours"](spark, SF).toPandas()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(v["embedding"].tolist(), np.float64), v["vec_id"].to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        others = ids != q
        near = ids[others][np.lexsort((ids[others], d[others]))[:10]]
        hits += len(set(near) & set(out[out["query_id"] == q]["vec_id"]))
        total += len(near)
    assert hits >= 0.9 * total


def test_pipeline(spark):
    import corpus_pipeline as p
    from tesserae.llm import decontaminate, pii
    from tesserae.llm.queries import SENTENCEPIECE_MODEL

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, SF).cache()
        assert docs.columns == p.COLUMNS, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.match_documents(spark, docs, bench).where("n_hit > 0").count() <= 0.01 * counts[-1]
    before = {r.e for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(pii.entities(F.col("text"))).alias("e")).collect()}
    after = {r.e for r in docs.select(F.explode(pii.entities(F.col("text"))).alias("e")).collect()}
    assert before and not before & after
    out = p.run(spark, SF).collect()
    assert len(out) == counts[-1] and all(r.round_trip for r in out)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in out)
