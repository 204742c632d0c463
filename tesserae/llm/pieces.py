"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here field by field (no generated classes): pieces with scores and
types, the trainer's kind, the normaliser's settings with its precompiled map. From them a
tokenizers pipeline is rebuilt: normaliser, metaspace marker, a unigram model from the scores or a
BPE model whose merges are derived from the scores' order, and byte fallback. Batches are encoded
by one thread, as a task has one core and its neighbours use the others.

A BPE model takes each text whole: cutting it into words costs more than the shorter queues of
pairs save. Pieces with a marker inside (after another sign) would bind words together. Where the
vocabulary of a unigram model has none, text is split before each run of markers, which changes no
result. Control pieces can't
stand in a text, so they are rebuilt under names with a space, which no normalised text holds.
User-defined symbols are found first in a BPE model's text (leftmost, then longest) and have a
score that always wins in a unigram model.

Parity: a codec encodes PROBES, and further ones made of each of the model's own control, byte and
user-defined pieces, both with the rebuilt pipeline and the sentencepiece library and refuses a model
on which they differ. encode() also encodes every text with the library and reports whether ids agree; a caller may ask
for fewer (every `parity_every`-th text of a batch, by its place in the batch, and every text that holds such a piece's name). All ids
are decoded again and compared with the normalised text. A unigram model with byte fallback can't tell a text's
literal `<0x41>` from the byte piece; texts with such a literal get the library's own ids.

Defined results: a null text has null ids; an empty text has no ids; repeated rows are encoded
each; an unknown sign (without byte fallback) makes round_trip false; very long texts, also without spaces, are
encoded whole, one at a time; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tesserae.llm.common import lean, small_batches

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"

#: Texts on which the rebuilt pipeline must give the library's ids.
PROBES = [
    "",
    " ",
    "a",
    "Hello world",
    "  two  spaces   three ",
    "line\nend\ttab\r\n",
    "▁mark ▁▁ marks",
    "Größe señor çà été ÄÖÜ ß",
    "日本語 русский עברית ไทย",
    "😀 emoji 👩‍👩‍👧 \u0000 ﻿",
    "ﬁ ligature 　 wide ½",
    "1234567890 12,345.67 !!! ### $$$",
    "<s> </s> <unk> <0x41>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "end of line\n",
    "日本語の長い文章です" * 9,
]


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind == 2:
            n = varint()
            value = data[i : i + n]
            i += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value = data[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {kind} isn't part of a model file")
        yield key >> 3, kind, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False
    charsmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls([])
        for number, _, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, _, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((text, score, kind))
            elif number == 2:
                for n, _, v in fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 24:
                        out.suffix = bool(v)
                    elif n == 35:
                        out.byte_fallback = bool(v)
                    elif n == 40:
                        out.unk_id = v
            elif number == 3:
                for n, _, v in fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n == 3:
                        out.prefix = bool(v)
                    elif n == 4:
                        out.squeeze = bool(v)
                    elif n == 5:
                        out.escape = bool(v)
        out.unk_id = next((i for i, p in enumerate(out.pieces) if p[2] == UNKNOWN), out.unk_id)
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are rebuilt")
        if out.suffix or not out.escape:
            raise ValueError("markers after words, or plain spaces, aren't rebuilt")
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which BPE joins them: by score, then by where the left part's piece stands."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for whole, (piece, score, kind) in enumerate(self.pieces):
            if kind != NORMAL:
                continue
            local = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            found += [(-score, whole, ids[a], ids[b], a, b) for a, b in local]
        found.sort()
        return [(a, b) for *_, a, b in found]

    def words_apart(self) -> bool:
        """Whether no piece holds a marker after another sign, and a lone marker is never unknown."""
        real = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        return not any(MARK in p.lstrip(MARK) for p in real) and (self.byte_fallback or MARK in real)

    def symbols(self) -> list[str]:
        return [p for p, _, kind in self.pieces if kind == USER_DEFINED]

    def names(self) -> list[str]:
        """Names of the pieces that aren't plain text: a text that holds one of them is always compared with the library."""
        return [p for p, _, kind in self.pieces if kind not in (NORMAL, UNUSED)]

    def normaliser(self) -> normalizers.Normalizer:
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:  # spaces alone, and markers at the end; a line end stays where the map leaves it
            steps += [normalizers.Replace(Regex(rf"\A +|[ {MARK}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix:
            steps.append(normalizers.Prepend(" "))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def build(self) -> Tokenizer:
        """The tokenizers pipeline for marked texts (normalised, with markers)."""
        name = [f" {p}" if kind in (UNKNOWN, CONTROL, UNUSED) else p for p, _, kind in self.pieces]
        if self.kind == UNIGRAM:
            real = [s for _, s, kind in self.pieces if kind == NORMAL]
            low, high = min(real, default=0.0), max([FLOAT_TINY, *real])
            # the library's rule for user-defined symbols; names that can't be met get the least score, which sets that of unknown signs
            score = lambda p, s, kind: s if kind == NORMAL else len(p.encode()) * high - 0.1 if kind == USER_DEFINED else low
            vocab = [(n, score(*piece)) for n, piece in zip(name, self.pieces, strict=True)]
            if min((s for _, s in vocab), default=low) < low:
                raise ValueError("user-defined symbols of a lower score than any piece aren't rebuilt")
            model = models.Unigram(vocab, unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        else:
            model = models.BPE({n: i for i, n in enumerate(name)}, self.merges(), unk_token=name[self.unk_id], byte_fallback=self.byte_fallback, fuse_unk=True)
        out = Tokenizer(model)
        if self.kind == BPE and self.symbols():
            out.add_tokens([AddedToken(p, normalized=False, special=False) for p in self.symbols()])
        if self.kind == UNIGRAM and self.words_apart():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix else [])])
        return out


#: The least normal 32-bit float, where the library's search for the best score begins.
FLOAT_TINY = 2.0**-126
#: UTF-8 bytes of texts that the library encodes at once; a longer text goes alone.
SLICE_BYTES = 1 << 20


class Codec:
    """The rebuilt pipeline beside the library that verifies it."""

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Model.parse(data)
        self.tokenizer = self.model.build()
        self.normaliser = self.model.normaliser()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = self.model.names()
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))) or r"(?!)")
        literal = [p for p, _, kind in self.model.pieces if kind == BYTE] if self.model.kind == UNIGRAM else []
        self.literal = re.compile("|".join(map(re.escape, literal))) if literal else None
        # each piece's bytes; an unknown sign's piece gives back none
        self.bytes_of = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == UNKNOWN else p.encode() for p, _, kind in self.model.pieces], pa.large_binary())
        if any(self.normaliser.normalize_str(f"x{p}x").lstrip(MARK) != f"x{p}x" for p in self.model.symbols()):
            raise ValueError("user-defined symbols that the normaliser changes aren't rebuilt")
        own = [x for p in names for x in (p, f"the {p} cat", f"a{p}{p}b", f"{p[:-1]} {p[1:]}")]
        probes = [*PROBES, *own, "".join(names)]
        bad = [t for t, a, b in zip(probes, self.encode(probes)[0], self.library.encode(probes, num_threads=1), strict=True) if a.tolist() != b]
        if bad:
            raise ValueError(f"the rebuilt pipeline differs from the library on {bad[:20]!r}")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's ids, and whether decoding gives the normalised text."""
        marked = [self.marked(t) for t in texts]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        for i in [i for i, t in enumerate(marked) if self.literal.search(t)] if self.literal else []:
            ids[i] = np.array(self.library.encode(texts[i]), np.int32)
        return ids, self.gives_back(ids, marked)

    def gives_back(self, ids: list[np.ndarray], marked: list[str]) -> np.ndarray:
        """Whether the bytes that ids stand for are those of the marked text."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        found = self.bytes_of.take(pa.array(flat))
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(flat) + 1]
        data = memoryview(found.buffers()[2] or b"").cast("B")
        at = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])]
        return np.array([data[a:b] == t.encode() for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), marked, strict=True)], bool)

    def marked(self, text: str) -> str:
        """The normalised text with its markers."""
        if self.model.charsmap or self.model.squeeze:
            return self.normaliser.normalize_str(text) if text else ""
        return (MARK if self.model.prefix and text else "") + text.replace(" ", MARK)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def normalised(self, text: str) -> str:
        """The text that decoding has to give back."""
        out = self.marked(text).replace(MARK, " ")
        return out[1:] if self.model.prefix else out


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of at most 128 texts and some SLICE_BYTES; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < 128 and (j == i or size + len(texts[j] or "") <= SLICE_BYTES):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes) -> Codec:
    """One codec for each model in a worker process."""
    if data not in _codecs:
        _codecs[data] = Codec(data)
    return _codecs[data]


def read_model(path: str) -> bytes:
    """A model file, read on the driver; its size is checked, as it goes to all executors."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a model file of over 64 MB isn't broadcast")
    return data


def encode(spark: SparkSession, documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", parity_every: int = 1) -> DataFrame:
    """Id, ids (array of int), round_trip (decoding gives the normalised text), parity (null where not compared)."""
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value)
        for batch in batches:
            every = batch.column(1).to_pylist()
            made = []  # one batch goes out for each that came, so freed memory is given back once
            for at, end in slices(every):
                texts = every[at:end]
                full = [i for i, t in enumerate(texts) if t is not None]
                done, back = c.encode([texts[i] for i in full])
                sizes = np.zeros(len(texts), np.int64)
                sizes[full] = [len(x) for x in done]
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *done])
                null = pa.array([t is None for t in texts])
                round_trip: list[bool | None] = [None] * len(texts)
                for i, ok in zip(full, back.tolist(), strict=True):
                    round_trip[i] = ok
                probe = [i for i in full if (at + i) % parity_every == 0 or c.special.search(texts[i])]
                parity: list[bool | None] = [None] * len(texts)
                for i, theirs in zip(probe, c.library.encode([texts[i] for i in probe], num_threads=1, out_type="numpy"), strict=True):
                    parity[i] = np.array_equal(flat[ends[i] : ends[i + 1]], theirs)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=null)
                made.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), ids, pa.array(round_trip, pa.bool_()), pa.array(parity, pa.bool_())], names=["id", "ids", "round_trip", "parity"]))
            if made:
                yield pa.concat_batches(made)

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(run), f"id {kind}, ids array<int>, round_trip boolean, parity boolean")
    return out.withColumnRenamed("id", id_col)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and the text that the ids stand for; null ids give null."""
    data = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = iter(c.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(back) for x in ids], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
