"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed 1- to 3-grams of a text's characters after lower-casing (runs of anything but
letters count as one space): term frequency in the text times inverse document frequency over all
learning rows. The weights are learned by follow-the-regularised-leader (proximal, per-coordinate
rates) with elastic-net penalties, so most stay zero; one temperature is then fitted on learning
rows that the weights haven't seen.

Bounds: weights are fitted on at most SAMPLE_ROWS labelled rows in all, an even share for each
language, chosen by the hash of their ids, each of at most SAMPLE_CHARS characters. Document
frequencies are counted over all learning rows, whole texts, and predictions read whole texts.

Defined results: a null text, or one without letters, is `und` with score 0; without any learning
row everything is `und`; with one language everything else gets it, with score 1; labels that are
null aren't learned from; a language with few learning rows is still learned; repeated rows are judged alike, and
equal scores go to the first language in order; an empty table gives no rows; language,
source and id are never inputs of a prediction; keep_known keeps all columns, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import lean, small_batches, trim

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000
BITS = 16
UNKNOWN = "und"
#: Texts are worked on in blocks of about so many characters.
BLOCK_CHARS = 100_000
_M = np.uint32(0x9E3779B1)


def _character_table() -> np.ndarray:
    """For each character of the basic plane: its lower-case form if it is a letter, else 0; marks count as letters."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_table: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(_character_table())
    low = _table[0][np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():  # beyond the basic plane: by the category of each distinct character
        distinct = np.unique(codes[far])
        kept = np.array([c if unicodedata.category(chr(c))[0] in "LM" else 0 for c in distinct.tolist()], np.uint32)
        low[far] = kept[np.searchsorted(distinct, codes[far])]
    return low


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """(first row, end row, texts joined with a line end) of blocks; a very long text is a block by itself."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") < BLOCK_CHARS):
            size += len(texts[j] or "") + 1
            j += 1
        yield i, j, "\n".join(t or "" for t in texts[i:j])
        i = j


def ngrams(texts: list[str | None], joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, letters by row) of all 1- to 3-grams; rows have a space at both ends."""
    n = len(texts)
    codes = np.frombuffer(f"\n{joined}\n".encode("utf-32-le"), np.uint32)
    lens = np.array([len(t or "") for t in texts], np.int64) + 1
    row = np.repeat(np.arange(n), lens)
    row = np.concatenate([[0], row])[: len(codes)]  # the sign before a text belongs to it
    low = _letters(codes)
    letters = np.bincount(row[low > 0], minlength=n)
    keep = np.ones(len(low), bool)  # one sign for a run of others
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0)
    ends = np.cumsum(lens)
    keep[0] = True
    keep[ends] = True  # the last sign of each text, also the first of the next
    low, row = low[keep], row[keep]
    h1 = (low + np.uint32(1)) * _M
    a = h1[:-1] ^ ((low[1:] + np.uint32(7)) * np.uint32(0x85EBCA77))
    b = (a[:-1] * np.uint32(0xC2B2AE3D)) ^ ((low[2:] + np.uint32(13)) * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - BITS)
    real1 = low > 0
    real2 = real1[:-1] | real1[1:]
    real3 = real1[1:-1]
    mixed = [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for h in (h1[real1], a[real2], b[real3])]
    rows = [row[real1], row[1:][real2], row[1:-1][real3]]  # the sign between two texts belongs to the first: pairs with it end in their own text
    return np.concatenate(rows), np.concatenate(mixed).astype(np.int64), letters


@dataclass
class Model:
    """Weights by feature and language, already times the inverse document frequency; all but few are zero."""

    languages: list[str]
    weights: np.ndarray  # (features, languages), float32
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits by row and language, and letters by row."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, j, joined in blocks(texts):
            row, feature, has = ngrams(texts[i:j], joined)
            total = np.maximum(np.bincount(row, minlength=j - i), 1)
            for k in range(len(self.languages)):
                out[i:j, k] = np.bincount(row, self.weights[:, k][feature], minlength=j - i) / total
            letters[i:j] = has
        return out + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, letters = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Term frequencies sum to 1 in a text; this brings them to a scale on which the learning rates work.
SCALE = 50.0


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, passes: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and bias by FTRL-proximal with elastic net; rows: (features, values)."""
    size = (1 << BITS) + 1  # the last coordinate is the bias, without penalties
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    rng = np.random.default_rng(seed)

    def solved(at: np.ndarray) -> np.ndarray:
        bias = (at == size - 1)[:, None]
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(bias, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(bias, 0.0, l2))

    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            feature, value = rows[i]
            at, x = np.append(feature, size - 1), np.append(value, 1.0)
            w = solved(at)
            p = softmax((x @ w)[None, :])[0]
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solved(np.arange(size))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]).mean())

    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts (column t) each feature occurs, over all rows, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, rows = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            rows += len(column)
            for i, j, joined in blocks(column):
                row, feature, _ = ngrams(column[i:j], joined)
                order = np.argsort(row, kind="stable")
                feature, ends = feature[order], np.cumsum(np.bincount(row, minlength=j - i))
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    seen[feature[a:b]] = True
                    df += seen
                    seen[feature[a:b]] = False
        at = np.flatnonzero(df)
        at, n = np.append(at, 1 << BITS), np.append(df[at], rows)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], names=["feature", "n"])

    counts = texts.mapInArrow(lean(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[counts["feature"]] = counts["n"]
    return out[:-1], int(out[-1])


def train(spark: SparkSession, documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from the rows for which learn holds, with texts and labels."""
    small_batches(spark)
    rows = documents.where(learn).where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("y"))
    fit_rows = rows.where(F.length("t") <= SAMPLE_CHARS)
    sizes = {r["y"]: (r["n"], r["short"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum((F.length("t") <= SAMPLE_CHARS).cast("long")).alias("short")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    df, n = document_frequencies(rows.select("t"))
    idf = np.log((1 + n) / (1 + df)) + 1
    share = max(1, SAMPLE_ROWS // len(languages))
    spread = 1 << 24
    bounds = {y: int(spread * min(1.0, share / max(short, 1))) for y, (_, short) in sizes.items()}
    bound = F.create_map(*[F.lit(x) for y in languages for x in (y, bounds[y])])
    chosen = fit_rows.where(F.pmod(F.xxhash64(F.lit("fit"), "i"), F.lit(spread)) < bound[F.col("y")])
    # counts of features are made where the texts are, so that the driver gets no texts
    sample = chosen.mapInArrow(lean(_counts), "i string, y string, features binary, counts binary").limit(2 * SAMPLE_ROWS).collect()
    sample.sort(key=lambda r: (r["y"], r["i"]))
    at = {y: k for k, y in enumerate(languages)}
    made, labels = [], []
    for r in sample:
        feature, count = np.frombuffer(r["features"], np.uint16 if BITS <= 16 else np.int32).astype(np.int64), np.frombuffer(r["counts"], np.float32)
        if len(feature):
            made.append((feature, SCALE * count * idf[feature]))
            labels.append(at[r["y"]])
    labels = np.array(labels, np.int64)
    # a fifth of each language's rows, after its first four, fits the temperature
    aside = np.zeros(len(labels), bool)
    for y in range(len(languages)):
        aside[np.flatnonzero(labels == y)[4::5]] = True
    weights, bias = fit_ftrl([m for m, a in zip(made, aside, strict=True) if not a], labels[~aside], len(languages))
    model = Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias)
    if aside.any() and len(languages) > 1:
        logits = np.array([x @ weights[f] + bias for (f, x), a in zip(made, aside, strict=True) if a])
        model.temperature = fit_temperature(logits, labels[aside])
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        features, counts = [], []
        for t in texts:
            _, feature, _ = ngrams([t], t)
            f, c = np.unique(feature, return_counts=True)
            features.append(f.astype(np.uint16 if BITS <= 16 else np.int32).tobytes())
            counts.append((c / max(1, c.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(features, pa.binary()), pa.array(counts, pa.binary())], names=["i", "y", "features", "counts"])


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of language and score for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(column: pd.Series) -> pd.DataFrame:
        languages, scores = shared.value.predict([None if t is None or t != t else t for t in column])
        trim()
        return pd.DataFrame({"lang": languages, "score": scores})

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the checksum of its id modulo 4 is 2; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred and score of every row."""
    model = train(spark, documents, ~held_out(id_col), id_col, text_col, label_col)
    found = predict(spark, model, F.col(text_col))
    rows = documents.select(F.col(id_col), held_out(id_col).alias("held_out"), found.alias("_found"))
    return rows.select(id_col, "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def keep_known(spark: SparkSession, documents: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents, all columns kept, without those whose language is unknown or scored below `least`."""
    model = train(spark, documents, ~held_out(id_col), id_col, text_col, label_col)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text_col).alias("text"))
    rows = rows.withColumn("found", predict(spark, model, F.col("text")))
    return rows.where((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= least)).select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
