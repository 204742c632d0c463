"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed side by side into multiword Shift-And masks. One pass over the bytes of a
URL moves all patterns at once: D = ((D << 1 | start) & mask[byte]) | (D & loop), where loop
holds the states before a `*`. A batch of URLs moves together, one numpy step per byte position,
so Python's cost is per position of the longest URL and not per URL.

A URL's canonical form is `.host?path`: neither part can hold a `?`, and every rule has one as a literal, so a host
pattern can't match inside a path. The host has A-Z lower-cased; the path stays as it is. A rule is literal
text unless it is `wild`: then `*` in its host and path is any run of bytes, `?` one byte.

Defined results: a null URL, or one without `://`, has an empty host and path and gets the
default verdict unless a rule fits `.?`. Repeated rows are judged alike, each by itself. Of
fitting rules the one with the longest text wins; of equally long ones, an allowing rule. An
empty rule list gives every row the default. Very long URLs are read to their end. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch

#: States of one automaton: 64 words, and 128 kB of masks.
BLOCK_STATES = 4096
#: UTF-8 bytes of rules in one step; their masks are some 32 times that.
PART_BYTES = 1 << 20
#: URLs that move together.
ROWS = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path; if wild, both are globs."""

    host: str
    path: str
    verdict: str
    wild: bool = False

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        host, path = (self.host, self.path) if self.wild else (escaped(self.host), escaped(self.path))
        return f"*.{host}\\?{path}*"


def escaped(text: str) -> str:
    """A text as a glob that matches only itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class WildcardAutomaton:
    """All globs at once. `*` is any run of bytes, `?` one byte, a backslash takes the next sign as it is."""

    def __init__(self, globs: list[str]):
        states: list[tuple[frozenset | None, bool]] = []  # bytes that lead into a state (None: any), and whether a star follows
        first, always, self.last, self.ends_in_star = [], [], [], []
        self.empty = []
        for k, glob in enumerate(globs):
            steps, lead, i = [], False, 0
            raw = glob.encode()
            while i < len(raw):
                c = raw[i : i + 1]
                if c == b"*":
                    if steps:
                        steps[-1] = (steps[-1][0], True)
                    else:
                        lead = True
                elif c == b"?":
                    steps.append((None, False))
                else:
                    if c == b"\\" and i + 1 < len(raw):
                        i += 1
                        c = raw[i : i + 1]
                    steps.append((frozenset(c), False))
                i += 1
            if not steps:
                self.empty.append((k, lead))
                self.last.append(-1)
                self.ends_in_star.append(lead)
                continue
            first.append(len(states))
            if lead:
                always.append(len(states))
            states += steps
            self.last.append(len(states) - 1)
            self.ends_in_star.append(steps[-1][1])
        self.words = max(1, (len(states) + 63) // 64)
        bits = lambda at: self._pack(at)
        self.not_first = ~bits(first)
        self.begin, self.again = bits(first), bits(always)
        self.loop = bits([i for i, s in enumerate(states) if s[1]])
        self.mask = np.zeros((256, self.words), np.uint64)
        for c in range(256):
            self.mask[c] = bits([i for i, s in enumerate(states) if s[0] is None or c in s[0]])

    def _pack(self, at: list[int]) -> np.ndarray:
        out = [0] * self.words
        for i in at:
            out[i // 64] |= 1 << (i % 64)
        return np.array(out, np.uint64)

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """Which glob matches which whole text: booleans by text and glob."""
        n = len(texts)
        lens = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.zeros((n, self.words), np.uint64)
        live = np.searchsorted(-lens, -np.arange(1, (lens[0] if n else 0) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for j, m in enumerate(live):  # the first m texts have a byte at j
            d = state[:m]
            moved = d << one
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            moved = (moved & self.not_first) | (self.begin if j == 0 else self.again)
            state[:m] = (moved & self.mask[data[at[:m] + j]]) | (d & self.loop)
        out = np.zeros((n, len(self.last)), bool)
        for k, last in enumerate(self.last):
            if last >= 0:
                out[order, k] = (state[:, last // 64] >> np.uint64(last % 64)) & one != 0
        for k, any_text in self.empty:
            out[order, k] = any_text | (lens == 0)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or where `://` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def parts_of(rules: list[Rule], most: int) -> Iterator[list[Rule]]:
    """Runs of rules whose globs have at most so many bytes; a longer one is alone."""
    held, size = [], 0
    for r in rules:
        n = len(r.glob.encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


class Judge:
    """Ranked rules as automata of bounded size."""

    def __init__(self, rules: list[Rule]):
        self.blocks = [(block, WildcardAutomaton([r.glob for r in block])) for block in parts_of(rules, BLOCK_STATES)]

    def first(self, texts: list[bytes]) -> list[Rule | None]:
        """The first rule in rank that fits each text."""
        out: list[Rule | None] = [None] * len(texts)
        for at in range(0, len(texts), ROWS):
            left = list(range(at, min(at + ROWS, len(texts))))
            for rules, automaton in self.blocks:
                if not left:
                    break
                fits = automaton.fits([texts[i] for i in left])
                found, which = fits.any(axis=1).tolist(), fits.argmax(axis=1).tolist()
                for i, yes, k in zip(left, found, which, strict=True):
                    if yes:
                        out[i] = rules[k]
                left = [i for i, yes in zip(left, found, strict=True) if not yes]
        return out


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (its text or null) and verdict of every row; a narrow plan without a shuffle."""
    spark = pages.sparkSession
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("_found"))
    scratch = None
    for k, part in enumerate(parts_of(ranked, PART_BYTES)):
        if k:
            scratch = scratch or Scratch(spark, "url-rules")
            rows = scratch.cut(rows, "part")
        rows = rows.withColumn("_found", F.coalesce("_found", _step(spark.sparkContext.broadcast(part))(F.concat(F.lit("."), "host", F.lit("?"), "path"))))
    return rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))


def _step(shared: Broadcast):
    made: list[Judge] = []

    @F.pandas_udf("rule string, verdict string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Judge(shared.value))
        for canonical in batches:
            found = made[0].first([t.encode() for t in canonical])
            yield pd.DataFrame({"rule": [r and r.text for r in found], "verdict": [r and r.verdict for r in found]}, dtype=object)

    # a struct without a rule is null, so that a later part's rule can stand
    def run(canonical: Column) -> Column:
        out = best(canonical)
        return F.when(out["rule"].isNotNull(), out)

    return run
