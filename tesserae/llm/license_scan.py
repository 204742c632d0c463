"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Texts are cut into lines and paragraphs (lines up to one without a word), and both into pieces of PIECE
words; two neighbouring pieces are a window. Windows of a paragraph run over line ends, so wrapped
notices are found; those inside a line are the line's own. Each window is classified by sparse multinomial logistic regression on hashed word 1-
and 2-grams (FTRL with elastic net) into licence families or `unknown`. The model is trained here:
families from templates with words dropped, swapped and surrounded by other text; `unknown` from
paragraphs of a bounded corpus sample that hold no distinctive template word, and from shuffled
template words. A temperature calibrates the probabilities, and the least probability that all families
together need is fitted on rows kept from training so that at most MOST_FALSE of unknown ones pass (MOST_LEAST at most). A
predicted family counts only if the window holds the words of one of its templates in
order: the longest common subsequence has to cover CONFIRM of the template. The words of a template
of up to SHORT words have to stand together.

Windows which no family can win are left out first, by an upper bound on the score, for
whole batches with numpy.

Sample bound, for fitting `unknown` alone: of about SAMPLE_ROWS documents (by the hash of their ids) the first SAMPLE_LINES
paragraphs, SAMPLE_CHARS signs of each; of these the SAMPLE_PARAGRAPHS with the least hashes (so that the layout of the files
doesn't matter), and of each SAMPLE_LINES lines of 2 * PIECE words. Scanning covers whole texts.

Defined results: a null or empty text has no families; of families with equal probabilities the first in order is confirmed;
a very long text is scanned whole, in bounded blocks; repeated rows are scanned alike; an empty
table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import NON_ALNUM, mix, small_batches, texts_of, word_blocks
from tesserae.llm.language_id import BITS, fit_ftrl, fit_temperature, softmax

# Passages that name each family.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License, version 3", "the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "distributed under the Apache License 2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the 3-Clause BSD License", "released under the BSD License"],
    "CC-BY": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "GPL": ["licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2", "the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License", "licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "proprietary": ["All rights reserved", "All rights reserved. No part of this work may be reproduced without written permission", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
UNKNOWN = "unknown"
PIECE = 20
SAMPLE_ROWS, SAMPLE_PARAGRAPHS = 600, 4000
SAMPLE_LINES, SAMPLE_CHARS = 8, 2000
MOST_FALSE, CONFIRM = 0.002, 0.85
#: A few licence-like paragraphs in a small sample can't raise the threshold beyond this; templates confirm in any case.
MOST_LEAST = 0.8
SHORT = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def words_of(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    return next(word_blocks([text.encode()], NON_ALNUM))[5]


def features(h: np.ndarray) -> np.ndarray:
    """Hashed 1-grams, and 2-grams with the word before; the first word's pair is its own."""
    before = np.concatenate([h[:1], h[:-1]])
    return np.concatenate([mix(h) >> _SHIFT, mix(before * _STEP + h) >> _SHIFT]).astype(np.int64)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, c = np.unique(features(h), return_counts=True)
    return f, SCALE * c / c.sum()


SCALE = 20.0


def common_part(template: list[int], window: list[int]) -> float:
    """The part of a template's words that stand in a window in order (longest common subsequence)."""
    row = [0] * (len(window) + 1)
    for t in template:
        last = 0
        for j, w in enumerate(window, 1):
            last, row[j] = row[j], last + 1 if t == w else max(row[j], row[j - 1])
    return row[-1] / max(1, len(template))


def similarity(template: list[int], window: list[int]) -> float:
    """common_part; nothing for a short template whose words don't stand together."""
    n = len(template)
    if n <= SHORT and not any(window[i : i + n] == template for i in range(len(window) - n + 1)):
        return 0.0
    return common_part(template, window)


@dataclass
class Classifier:
    """Weights by feature and family (the last one is unknown), their calibration, and templates as word hashes."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: list[list[list[int]]]

    def __post_init__(self):
        margin = self.weights[:, :-1] - self.weights[:, -1:]
        self.margin = margin.max(axis=1)  # what a feature can win for any family at most
        self.margin_bias = float((self.bias[:-1] - self.bias[-1]).max())

    def scan(self, paragraph: np.ndarray, h: np.ndarray, line: np.ndarray | None = None) -> Iterator[tuple[int, str, float, float]]:
        """(first word, family, probability, similarity) of windows in which a family is found and confirmed.

        paragraph: each word's, ascending; h: each word's hash. With line (each word's), only windows over a line end.
        """
        if not len(h):
            return
        first = np.concatenate([[True], paragraph[1:] != paragraph[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        cut = (np.arange(len(h)) - start) % PIECE == 0
        at = np.flatnonzero(cut)
        ends = np.concatenate([at[1:], [len(h)]])
        f = features(h)
        best = self.margin[f[: len(h)]] + self.margin[f[len(h) :]]
        sums, sizes = np.add.reduceat(best, at), ends - at
        joined = np.concatenate([paragraph[at][1:] == paragraph[at][:-1], [False]])
        total, size = sums + np.where(joined, np.append(sums[1:], 0), 0), sizes + np.where(joined, np.append(sizes[1:], 0), 0)
        follows = np.concatenate([[False], joined[:-1]])
        hope = total * SCALE / (2 * size) + self.margin_bias > 0
        for k in np.flatnonzero(hope & (joined | ~follows)).tolist():
            a, b = int(at[k]), int(ends[k + 1] if joined[k] else ends[k])
            if line is not None and line[a] == line[b - 1]:
                continue
            window = h[a:b]
            x, v = counted(window)
            p = softmax(((v @ self.weights[x]) + self.bias)[None, :] / self.temperature)[0]
            family = int(p[:-1].argmax())
            if 1 - p[-1] < max(self.least, 0.5):  # families with words in common share what isn't unknown's
                continue
            own = window.astype(np.int64).tolist()
            close = max(similarity(t, own) for t in self.templates[family])
            if close >= CONFIRM:
                yield a, self.names[family], float(p[family]), close


def train(unknown: list[np.ndarray], seed: int = 11) -> Classifier:
    """A classifier from the templates and from word hashes of paragraphs without a licence."""
    rng = np.random.default_rng(seed)
    names = sorted(TEMPLATES)
    templates = [[words_of(t) for t in TEMPLATES[n]] for n in names]
    everything = np.concatenate([t for own in templates for t in own])
    other = np.concatenate([*unknown, everything]) if unknown else everything
    rows, labels = [], []
    for k, own in enumerate(templates):
        for t in own:
            for _ in range(60):
                h = t[rng.random(len(t)) > rng.choice([0.0, 0.05])]
                around = [rng.choice(other, rng.integers(0, 12)) for _ in range(2)]
                rows.append(np.concatenate([around[0], h if len(h) else t, around[1]]))
                labels.append(k)
    negative = [u for u in unknown if len(u)]
    negative += [rng.choice(everything, rng.integers(1, 2 * PIECE)) for _ in range(400)]
    negative += [np.concatenate([rng.choice(other, rng.integers(1, PIECE)), rng.choice(everything, 2)]) for _ in range(400)]
    rows += negative
    labels = np.array(labels + [len(names)] * len(negative))
    made = [counted(h) for h in rows]
    aside = rng.random(len(rows)) < 0.25
    kept = [m for m, a in zip(made, aside, strict=True) if not a]
    weights, bias = fit_ftrl(kept, labels[~aside], len(names) + 1, l1=0.05)
    logits = np.array([v @ weights[f] + bias for (f, v), a in zip(made, aside, strict=True) if a])
    temperature = fit_temperature(logits, labels[aside])
    p = softmax(logits / temperature)
    false = np.sort(1 - p[labels[aside] == len(names), -1])
    least = float(np.clip(false[int(len(false) * (1 - MOST_FALSE)) - 1], 0.3, MOST_LEAST)) if len(false) else 0.5
    return Classifier(names, weights, bias, temperature, least, [[t.astype(np.int64).tolist() for t in own] for own in templates])


def lines_of(counts: np.ndarray, rows: list[bytes | None], starts: np.ndarray) -> np.ndarray:
    """Each word's line, numbered over a block of texts."""
    out, at, base = np.zeros(len(starts), np.int64), 0, 0
    for t, c in zip(rows, counts.tolist(), strict=True):
        if c:
            lines = np.flatnonzero(np.frombuffer(t, np.uint8) == 10)
            out[at : at + c] = base + np.searchsorted(lines, starts[at : at + c])
            base += len(lines) + 1
        at += c
    return out


def paragraphs(line: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each word's paragraph: a new one after a line without a word, and with each text."""
    return np.concatenate([[0], np.cumsum((np.diff(line) > 1) | (np.diff(row) > 0))])


def unknown_paragraphs(documents: DataFrame) -> list[np.ndarray]:
    """Word hashes of a bounded sample's paragraphs that hold no distinctive template word."""
    n = documents.count()
    spread = 1 << 24
    bound = int(spread * min(1.0, SAMPLE_ROWS / max(n, 1)))
    rows = documents.where(F.pmod(F.xxhash64(F.lit("licence"), "id"), F.lit(spread)) < bound).where("t is not null")
    parts = rows.select(F.explode(F.slice(F.split("t", r"\n[^\p{L}\p{N}\n]*\n"), 1, SAMPLE_LINES)).alias("part")).select(F.substring("part", 1, SAMPLE_CHARS).alias("part"))
    parts = parts.orderBy(F.xxhash64("part"), "part").limit(SAMPLE_PARAGRAPHS)
    marks = {int(h) for own in TEMPLATES.values() for t in own for h, w in zip(words_of(t).tolist(), t.split(), strict=False) if len(w) > 6}
    found = []
    for r in parts.collect():
        # a licence wrapped over lines has lines without a mark, so one mark excludes the paragraph
        lines = [words_of(x) for x in r["part"].split("\n")]
        if not any(marks & set(h.tolist()) for h in lines):
            found += [h[: 2 * PIECE] for h in lines[:SAMPLE_LINES] if len(h)]
    return found


def scan(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, families (sorted), n_passages, score and similarity (best; null where none).

    n_passages: windows in which a family was confirmed; those over line ends count where no line of the paragraph holds the family.
    """
    small_batches(spark)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    model = train(unknown_paragraphs(docs))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            found: list[list[tuple]] = [[] for _ in texts]
            for first, rows, counts, starts, _, hashes in word_blocks(texts, NON_ALNUM):
                if not len(hashes):
                    continue
                line, row = lines_of(counts, rows, starts), np.repeat(np.arange(len(rows)), counts)
                paragraph, seen = paragraphs(line, row), set()
                for a, family, probability, close in shared.value.scan(line, hashes):
                    seen.add((int(paragraph[a]), family))
                    found[first + int(row[a])].append((family, probability, close))
                for a, family, probability, close in shared.value.scan(paragraph, hashes, line):
                    if (int(paragraph[a]), family) not in seen:
                        found[first + int(row[a])].append((family, probability, close))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([max((x[1] for x in f), default=None) for f in found], pa.float64()),
                    pa.array([max((x[2] for x in f), default=None) for f in found], pa.float64()),
                ],
                names=["id", "families", "n_passages", "score", "similarity"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, families array<string>, n_passages long, score double, similarity double")
    return out.withColumnRenamed("id", id_col)
