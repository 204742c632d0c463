"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The automaton holds all
normalised items; the words of a training text stream through it, and it tracks the longest match
that ends at each word. A window is `window` consecutive words of an item, or a whole shorter item.
A word is hit if it lies inside an occurrence of a window. Since no match crosses a word pair that
no item holds, the stream skips to runs of pairs that some item holds (found with numpy over whole
blocks of texts); elsewhere the longest match is shorter than any window, except for windows of
one word, whose words count as runs by themselves.

The automaton goes to the executors in parts of at most PART_BYTES of item texts, so its size there
has a bound whatever the benchmark's size; an item beyond that is cut into pieces that overlap by window - 1 words, so
every window lies in one. Usual benchmarks are one part, and nothing is shuffled. With several parts, a filter of all windows'
hashes (FILTER_BYTES at most) first tells the texts that can hold one; these alone are written, each part's
automaton streams them and writes spans and items by row, and one join at the end brings them together.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; items with equal texts are all found; repeated documents are each reported; an empty
benchmark hits nothing; an empty table gives no rows; very long texts are streamed in blocks; match_documents looks at no
other columns, remove_contamination keeps all of them, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import NON_ALNUM, Scratch, lean, mix, small_batches, texts_of, word_blocks

#: UTF-8 bytes of item texts in one automaton: some 100,000 words and twice as many states, about 100 MB.
PART_BYTES = 600_000
#: Bytes of the filter of windows; with more windows than bits it lets more texts through to the automata.
FILTER_BYTES = 1 << 25
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word ids, with the windows of each state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []  # every prefix state of an item
        whole: list[tuple[int, int, str]] = []  # the state of a short item as a whole
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if len(words) >= window:
                    ends.append((last, item))
            if 0 < len(words) < window:
                whole.append((last, len(words), item))
        self._index(ends, whole)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _index(self, ends: list[tuple[int, str]], whole: list[tuple[int, int, str]]) -> None:
        """For each state: the state of its suffix of window words with its items, and short items that end there."""
        n, window = len(self.next), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.full = [-1] * n  # the ancestor whose strings include the suffix of window words
        self.short: dict[int, list] = {}  # (length, item) of the short items that end in a state by themselves
        self.above = [-1] * n  # the nearest state up the links, itself included, that has some
        for s, k, item in whole:
            self.short.setdefault(s, []).append((k, item))
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.full[s] = s if self.length[up] < window else self.full[up]
            self.above[s] = s if s in self.short else self.above[up]
        self.items: dict[int, set[str]] = {}
        for s, item in ends:
            if self.full[s] >= 0:
                self.items.setdefault(self.full[s], set()).add(item)

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, list | tuple]]:
        """(end, longest window that ends there, items) for each word at which a window ends."""
        state, size, window = 0, 0, self.window
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            found: set[str] = set()
            reach = 0
            if size >= window:
                reach = size  # all of it lies inside windows of one item or another
                found |= self.items.get(self.full[state], set())
            at = self.above[state]
            while at >= 0:
                for k, item in self.short[at]:
                    if k <= size:
                        found.add(item)
                        reach = max(reach, k)
                at = self.above[self.link[at]] if at else -1
            if reach:
                yield i, reach, found


@dataclass
class Matcher:
    """The automaton with its vocabulary as hashes, and the filters that find runs worth streaming."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    singles: np.ndarray
    need: int
    automaton: SuffixAutomaton

    @classmethod
    def build(cls, items: list[tuple[str, bytes | None]], window: int) -> Matcher:
        hashed = []
        for _, _, counts, _, _, hashes in word_blocks([t for _, t in items], NON_ALNUM):
            hashed += np.split(hashes, np.cumsum(counts)[:-1])
        vocabulary = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        ids = [np.searchsorted(vocabulary, h).tolist() for h in hashed]
        pairs = np.zeros(1 << _PAIR_BITS, bool)
        for h in hashed:
            pairs[_pair_slots(h)] = True
        singles = np.unique(np.concatenate([*(h for h in hashed if len(h) == 1), np.zeros(0, np.uint64)]))
        need = min([window, *(len(h) for h in hashed if len(h) > 1)])
        return cls(vocabulary, pairs, singles if window > 1 else vocabulary, max(need, 2), SuffixAutomaton([(k, w) for (k, _), w in zip(items, ids, strict=True)], window))

    def find(self, counts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, set]]:
        """(row, first word, end word, items) of each window's occurrence in a block of texts."""
        if not len(self.vocabulary) or not len(hashes):
            return
        n = len(hashes)
        row_end = np.cumsum(counts)
        linked = np.zeros(n + 1, bool)  # whether word i and the one before may stand together in an item
        linked[1:n] = self.pairs[_pair_slots(hashes)]
        linked[row_end] = False
        edges = np.flatnonzero(linked[1:] != linked[:-1])
        starts, ends = edges[0::2], edges[1::2] + 1  # runs of linked words, as word positions
        keep = ends - starts >= self.need
        runs = list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
        if len(self.singles):
            inside = np.zeros(n + 1, np.int32)
            inside[starts[keep]] += 1
            inside[ends[keep]] -= 1
            alone = np.flatnonzero(np.isin(hashes, self.singles) & (np.cumsum(inside[:-1]) == 0)).tolist()
            runs = sorted([*runs, *((i, i + 1) for i in alone)])
        for a, b in runs:
            row = int(np.searchsorted(row_end, a, side="right"))
            base = int(row_end[row] - counts[row])
            at = np.searchsorted(self.vocabulary, hashes[a:b])
            at[at == len(self.vocabulary)] = 0
            ids = np.where(self.vocabulary[at] == hashes[a:b], at, -1).tolist()
            for i, reach, items in self.automaton.stream(ids):
                end = a + i + 1 - base
                yield row, end - reach, end, items


_PAIR_BITS = 20


def _pair_slots(h: np.ndarray) -> np.ndarray:
    return (mix(h[:-1] * _PAIR + h[1:]) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def load_items(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items, long ones in pieces, in parts of bounded size; one empty part for an empty benchmark."""
    part, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t")).where("t is not null and i is not null")
    for r in rows.toLocalIterator():
        for piece in _pieces(bytes(r["t"]), window):
            if part and size + len(piece) > PART_BYTES:
                yield part
                part, size = [], 0
            part.append((r["i"], piece))
            size += len(piece)
    yield part


def _pieces(text: bytes, window: int) -> Iterator[bytes]:
    """The text, or pieces of some PART_BYTES that share window - 1 words with the next."""
    if len(text) <= PART_BYTES:
        yield text
        return
    _, _, counts, starts, ends, _ = next(word_blocks([text], NON_ALNUM))
    n, i = int(counts[0]), 0
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + PART_BYTES, side="right")), i + window)
        yield text[starts[i] : ends[min(j, n) - 1]]
        if j >= n:
            return
        i = j - (window - 1)


_SPAN = "struct<first:int,last:int,start:int,stop:int>"
_FOUND = f"_n_words long, _spans array<{_SPAN}>, _items array<string>"


def _stream(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, window: int, text_at: int) -> DataFrame:
    """rows (columns c0, c1 and so on) with _n_words, _spans and _items added."""
    small_batches(spark)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    parts = load_items(benchmark, window)
    first, second = next(parts), next(parts, None)
    if second is None:
        return rows.mapInArrow(lean(_step(Matcher.build(first, window), text_at)), f"{kept}, {_FOUND}")
    windows = WindowFilter(window)
    for part in itertools.chain([first, second], parts):
        windows.add(part)
    scratch, shared = Scratch(spark, "decontaminate"), spark.sparkContext.broadcast(windows)
    told = rows.mapInArrow(lean(_maybe(shared, text_at)), f"{kept}, _n_words long, _can boolean")
    some = scratch.cut(told.where("_can").withColumn("_row", F.monotonically_increasing_id()), "candidates")
    texts = some.select("_row", f"c{text_at}")
    found = []
    for part in load_items(benchmark, window):
        one = texts.mapInArrow(lean(_step(Matcher.build(part, window), 1)), f"_row long, c{text_at} string, {_FOUND}")
        found.append(scratch.cut(one.where(F.size("_items") > 0).select("_row", "_spans", "_items"), "spans"))
    spans = functools.reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    # spans of several parts are joined where they touch, as _merged() does
    merged = F.aggregate(
        F.array_sort("_all"),
        F.array().cast(f"array<{_SPAN}>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["last"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_joined(F.try_element_at(acc, F.lit(-1)), s)))).otherwise(F.concat(acc, F.array(s))),
    )
    spans = scratch.cut(spans.select("_row", merged.alias("_spans"), "_items"), "merged")
    hit = some.join(spans, "_row", "left")
    none = [F.array().cast(f"array<{_SPAN}>"), F.array().cast("array<string>")]
    whole = hit.select(*rows.columns, "_n_words", F.coalesce("_spans", none[0]).alias("_spans"), F.coalesce("_items", none[1]).alias("_items"))
    return whole.unionByName(told.where("not _can").select(*rows.columns, "_n_words", none[0].alias("_spans"), none[1].alias("_items")))


def _joined(a: Column, b: Column) -> Column:
    return F.struct(a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["stop"], b["stop"]).alias("stop"))


class WindowFilter:
    """Bits of the hashes of all windows, and the lengths that windows have."""

    def __init__(self, window: int):
        self.window, self.bits = window, np.zeros(FILTER_BYTES, np.uint8)
        self.lengths: set[int] = set()

    def add(self, items: list[tuple[str, bytes]]) -> None:
        for _, _, counts, _, _, hashes in word_blocks([t for _, t in items], NON_ALNUM):
            for h in np.split(hashes, np.cumsum(counts)[:-1]):
                if len(h):
                    k = min(len(h), self.window)
                    self.lengths.add(k)
                    slots = self._slots(h, k)
                    np.bitwise_or.at(self.bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))

    def _slots(self, h: np.ndarray, k: int) -> np.ndarray:
        """Of each run of k words."""
        n = len(h) - k + 1
        total = np.zeros(max(n, 0), np.uint64)
        for i in range(k):
            total = mix(total + _PAIR) + h[i : i + n]
        return (mix(total) % np.uint64(len(self.bits) * 8)).astype(np.int64)

    def can(self, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Whether each text of a block can hold a window."""
        out = np.zeros(len(counts), bool)
        row = np.repeat(np.arange(len(counts)), counts)
        for k in self.lengths:
            slots = self._slots(hashes, k)
            hit = np.flatnonzero((self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
            out[row[hit[row[hit] == row[hit + k - 1]]]] = True
        return out


def _maybe(shared: Broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            n_words, can = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for first, _, counts, _, _, hashes in word_blocks(texts, NON_ALNUM):
                n_words[first : first + len(counts)] = counts
                can[first : first + len(counts)] = shared.value.can(counts, hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(can)], names=[*batch.schema.names, "_n_words", "_can"])

    return run


def _step(matcher: Matcher, text_at: int):
    span = pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text_at))
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list[tuple]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            for first, _, counts, starts, ends, hashes in word_blocks(texts, NON_ALNUM):
                n_words[first : first + len(counts)] = counts
                base = np.cumsum(counts) - counts
                for row, a, b, found in matcher.find(counts, hashes):
                    spans[first + row].append((a, b, int(starts[base[row] + a]), int(ends[base[row] + b - 1])))
                    items[first + row] |= found
            merged = [[dict(zip(("first", "last", "start", "stop"), s, strict=True)) for s in _merged(x)] for x in spans]
            columns = [pa.array(n_words), pa.array(merged, pa.list_(span)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_n_words", "_spans", "_items"])

    return run


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans in order, joined where they touch."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            p = out.pop()
            s = (p[0], max(p[1], s[1]), p[2], max(p[3], s[3]))
        out.append(s)
    return out


def match_documents(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_words, n_hit, spans (words and UTF-8 bytes, merged and in order) and items (ids as sorted strings) of every row."""
    rows = documents.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    out = _stream(spark, rows, benchmark, window, 1)
    return out.select(
        F.col("c0").alias(id_col),
        F.col("_n_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"]).alias("n_hit"),
        F.col("_spans").alias("spans"),
        F.col("_items").alias("items"),
    )


def remove_contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with the hit spans cut from their texts; those hit beyond max_coverage of their words go."""
    columns = documents.columns
    at = columns.index(text_col)
    hit = _stream(spark, documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]), benchmark, window, at)
    text = F.col(f"c{at}")
    raw = F.encode(text, "UTF-8")
    size = F.length(raw)
    # what stands before each span, and after the last
    fold = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["stop"].alias("at"),
            F.concat(acc["out"], F.decode(F.substr(raw, acc["at"] + 1, s["start"] - acc["at"]), "UTF-8")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.decode(F.substr(raw, acc["at"] + 1, size - acc["at"]), "UTF-8")),
    )
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    kept = hit.where((F.col("_n_words") == 0) | (n_hit <= F.col("_n_words") * F.lit(max_coverage)))
    cut = F.when(F.size("_spans") > 0, fold).otherwise(text)
    return kept.select(*[(cut if k == at else F.col(f"c{k}")).alias(c) for k, c in enumerate(columns)])
