"""The corpus pipeline against a brute-force version of every stage, on a table of hard cases."""

import random
import unicodedata

import regex
import sentencepiece
from pyspark.sql import functions as F
from test_decontaminate import LOW, WORD
from test_jaccard_join import brute
from test_language_id import corpus
from test_pii import by_hand

import corpus_pipeline as p
from tesserae.llm import pii
from tesserae.llm.queries import PII_KEY, SENTENCEPIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WINDOW, COVERAGE = 10, 0.8
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)


def fixture():
    """Rows and benchmark items: nulls, empty and very long texts, copies, near copies, repeated rows, passages, entities."""
    rng = random.Random(11)
    docs = [(i * 2, t, y) for i, t, y in corpus(60, seed=4)]
    passage = " ".join(f"item{k}" for k in range(14))
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(90_000))
    body = " ".join(f"body{k}" for k in range(50))
    docs += [
        (201, None, "en"), (202, "", "de"), (203, "12 !? 99", None), (204, " \n\t", "fr"),
        (210, body, "en"), (211, body, "en"), (212, body + " more", "en"), (209, body.upper(), None), (213, body, "de"), (213, body, "de"),
        (220, long, "en"), (221, long + " tail", "en"),
        (230, f"before it {passage}, after the thing with more words to come, and a few of them", "en"), (231, passage, "en"), (232, f"Wh {passage.upper()} é ü {passage} the end of a text with words of its own", None),
        (233, " ".join(passage.split()[:9]) + " and no window", "en"), (234, "Short item", "en"), (235, "it has the short item in it", "fr"),
        (240, "mail a.b@mail.example.com or 10.0.0.7 and A.B@MAIL.EXAMPLE.COM", "en"), (241, 'token = "0123456789abcdef0123" in the text', "en"),
        (242, f"call +1 (499) 555-6503 {passage} or 078-05-1120 and card 4532015112830366 in words to be kept", "en"),
        (None, "the row without an id stays and the others go", "en"), (250, "日本語のテキスト 😀 ende", None), (251, "words", "en"), (251, "and words", "en"),
    ]
    rows = [(i, t, y, f"s{k % 3}" if k % 7 else None, None if k % 5 == 0 else len(t or "")) for k, (i, t, y) in enumerate(docs)]
    return rows, [(1, passage), (2, "short ITEM"), (3, None), (4, ""), (5, passage)]


def known(rows):
    return [r for r in rows if r[1] and any(unicodedata.category(c)[0] == "L" for c in r[1])]


def one_each(rows):
    """The least text of the smallest id of each component; rows without an id here link to none."""
    least = {i: root for i, (_, root) in brute([(r[0], r[1]) for r in rows if r[0] is not None]).items()}
    kept = {}
    for r in rows:
        if r[0] is not None and least[r[0]] == r[0]:
            kept[r[0]] = min(kept.get(r[0], r), r, key=lambda x: x[1].encode())
    return [*kept.values(), *[r for r in rows if r[0] is None]]


def without_items(rows, items):
    """Runs of hit words go, from the first's begin to the last's end; texts hit beyond the bound go whole."""
    windows = set()
    for _, t in items:
        v = WORD.findall((t or "").translate(LOW))
        windows |= {tuple(v[i : i + WINDOW]) for i in range(max(1, len(v) - WINDOW + 1)) if v}
    out = []
    for i, text, lang, source, _ in rows:
        at = [(m[0], m.start(), m.end()) for m in WORD.finditer(text.translate(LOW))]
        spans = [(k, k + len(w)) for w in windows for k in range(len(at)) if at[k][0] == w[0] and tuple(a[0] for a in at[k : k + len(w)]) == w]
        hit = {k for a, b in spans for k in range(a, b)}
        if at and len(hit) > COVERAGE * len(at):
            continue
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[: at[a][1]] + text[at[b - 1][2] :]
        out.append((i, text, lang, source, len(text)))
    return out


def surrogates(rows):
    texts = [regex.sub(pii.ENTITY, lambda m: by_hand(m[0], PII_KEY), r[1]) for r in rows]
    return [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts, strict=True)]


def encoded(rows):
    return [(r[0], len(LIBRARY.encode(r[1])), LIBRARY.encode(r[1]), True) for r in rows]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folder(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_run_by_brute_force(spark, tmp_path):
    rows, items = fixture()
    sf = folder(spark, tmp_path, rows, items)
    want = rows
    by_name = {"language_id": known, "ngram_jaccard_join": one_each, "benchmark_decontamination": lambda r: without_items(r, items), "pii": surrogates, "sentencepiece": encoded}
    assert list(by_name) == [name for name, _ in p.STAGES]
    sizes = []
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(want, SCHEMA)
        got, want = collected(stage(spark, docs, sf)), sorted(by_name[name](want), key=repr)
        assert got == want, name
        sizes.append(len(want))
    # the cases of the fixture take effect
    assert len(rows) - sizes[0] == 4 and sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    assert collected(p.run(spark, sf)) == want


def test_other_columns_and_their_order(spark, tmp_path):
    """Columns of any name beside those of documents don't matter; every stage but the last returns those of documents."""
    rows, items = fixture()
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    sf = folder(spark, tmp_path, rows, items)
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["_row", "_text", "_entities", "_new", "row", "found", "id", "ids", "cls", "c0", "c1", "_n_words", "_spans", "_items", "least", "_maybe", "n_tokens"]
    wide = docs.select(*[F.lit(k).alias(n) for k, n in enumerate(names)], *reversed(docs.columns))
    for name, stage in p.STAGES:
        a, b = stage(spark, docs, sf), stage(spark, wide, sf)
        assert a.columns == b.columns == (p.COLUMNS if name != "sentencepiece" else ["doc_id", "n_tokens", "ids", "round_trip"])
        assert collected(a) == collected(b), name


def test_nulls_empty_tables(spark, tmp_path):
    """Each stage with null columns, with no documents, and with an empty benchmark."""
    sf = folder(spark, tmp_path, [], [])
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, None, None, None, None), (2, "", None, None, None), (3, "a text", None, None, 6)], SCHEMA)
    left = {}
    for name, stage in p.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0, name
        left[name] = [r[0] for r in collected(stage(spark, nulls, sf))]
    # without a labelled row no language is known; the other stages leave texts that hold nothing of theirs
    assert left == {"language_id": [], **{n: [1, 2, 3, None, None] for n, _ in p.STAGES[1:]}}
    assert p.run(spark, sf).count() == 0
