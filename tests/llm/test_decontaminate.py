import random
import re

import pytest

from tesserae.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            wins = [v[i : i + window] for i in range(len(v) - window + 1)] if len(v) >= window else [v] if v else []
            for x in wins:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, window):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in d.match_documents(spark, a, b, window).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "cé", "d9", "ee"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(12)] + [(50, None), (51, "B B B B B"), (52, "B B B B B")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (7, "B b B b B b B"), (7, "B b B b B b B")]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_parts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_BYTES", 40)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["x", "yy", "zzz"]) for _ in range(n))
    items = [(i, text(12)) for i in range(5)]
    docs = [(i, text(50)) for i in range(10)] + [(99, text(900_000) + " tail")]
    got, want = run(spark, docs[:10], items, 6), brute(docs[:10], items, 6)
    assert got == want
    monkeypatch.setattr(d, "FILTER_BYTES", 2)  # a full filter only lets more texts through
    assert run(spark, docs[:10], items, 6) == want
    long = run(spark, docs[10:], items, 6)[0]
    assert long[1] == 900_001 and long[3] == ["0", "1", "2", "3", "4"]


def test_empty_benchmark_and_table(spark):
    assert run(spark, [(1, "a b")], [], 10) == [(1, 2, 0, [])]
    assert run(spark, [], [(1, "a b")], 10) == []


@pytest.mark.parametrize("coverage,left", [(0.8, {1, 2, 3, 4}), (1.0, {1, 2, 3, 4, 5})])
def test_removal(spark, coverage, left):
    item = "one two three four five"
    docs = [(1, "clean words only", "x"), (2, f"before {item}; after it all", "x"), (3, None, "x"), (4, "", None), (5, item, "x")]
    a = spark.createDataFrame(docs, "doc_id long, text string, _text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in d.remove_contamination(spark, a, b, 4, coverage).collect()}
    assert set(out) == left and out[2].text == "before ; after it all" and out[1].text == docs[0][1] and out[3].text is None
    assert out[1]["_text"] == "x"


def test_many_parts_with_short_and_long_items(spark, monkeypatch):
    """Items cut into pieces, items shorter than a window, documents without a hit, and several spans in a text."""
    monkeypatch.setattr(d, "PART_BYTES", 60)
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(120)), (2, text(3)), (3, text(1)), (4, text(2)), (5, text(40)), (6, "v1"), (7, "v1 v1")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(40)] + [(100, "none of these"), (101, None)]
    docs += [(200, " ".join(items[0][1].split()[20:90]) + " zz " + items[4][1])]
    assert len(list(d.load_items(spark.createDataFrame(items, "item_id long, text string"), 4))) > 5
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_nested_short_items():
    """Many short items that end in one another: outputs are found by links, not copied into every state."""
    names = [(str(k), list(range(9 - k, 10))) for k in range(9)]
    automaton = d.SuffixAutomaton([*names, ("long", list(range(30)))], 20)
    found = {i: (reach, sorted(items)) for i, reach, items in automaton.stream(list(range(25)))}
    assert found[9] == (9 + 0, [str(k) for k in range(9)]) and found[19][0] == 20 and found[24] == (25, ["long"])
    assert sum(map(len, automaton.short.values())) == 9


@pytest.mark.parametrize("part", [600_000, 40])
def test_clashing_columns(spark, monkeypatch, part):
    monkeypatch.setattr(d, "PART_BYTES", part)
    item = "one two three four five six seven"
    df = spark.createDataFrame([(1, f"a {item} b", "s", 5, "i", 1.5), (2, "clean", None, None, None, None)], "doc_id long, text string, _spans string, _n_words int, _items string, c1 double")
    bench = spark.createDataFrame([(1, item), (2, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    out = d.remove_contamination(spark, df, bench, 4, 1.0)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a  b", "s", 5, "i", 1.5), (2, "clean", None, None, None, None)]
