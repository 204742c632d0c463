import dataclasses
import os
import random
import struct
import time

import pytest
import sentencepiece
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tesserae.llm import pieces
from tesserae.llm.queries import SENTENCEPIECE_MODEL as PATH


def test_parity_and_round_trip(spark):
    rng = random.Random(1)
    signs = [" ", "  ", "a", "the", "é", "\n", "▁", "日本", "😀", "7", ".", "x" * 50, "<s>", "\t", " ", "<0x41>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", " ", "word " * 100_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(spark, df, PATH, parity_every=1)
    got = sorted((r.doc_id, r["ids"], r.round_trip, r.parity) for r in out.collect() if r["ids"] is not None)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got == sorted((i, lib.encode(t), True, True) for i, t, _ in rows if t is not None)
    back = {r.doc_id: r.text for r in pieces.decode(spark, out, PATH).collect()}
    assert back == {i: t and t.replace("▁", " ") for i, t, _ in rows}  # the model itself reads a marker as a space
    assert pieces.encode(spark, df.limit(0), PATH).count() == 0
    special = pieces.encode(spark, df, PATH, parity_every=10**9).where("parity is not null").count()
    assert special >= sum("<s>" in t or "<0x41>" in t for t in texts if t)


def test_long_text_without_spaces():
    codec = pieces.Codec(pieces.read_model(PATH))
    text = "".join(chr(0x3041 + i * i % 80) for i in range(400_000))
    (ids,), ok = codec.encode([text])
    assert ok.all() and codec.decode([ids.tolist()]) == [text] and ids.tolist() == codec.library.encode(text)
    assert list(pieces.slices([text * 4, None, "a", text * 4])) == [(0, 1), (1, 3), (3, 4)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind, byte_fallback=False, symbols=(), squeeze=True, prefix=True, charsmap=b""):
    """A small model file, written by hand: nothing is trained."""
    rng = random.Random(4)
    words = ["▁", "a", "b", "c", "t", "h", "e", "s", "<", ">", "0", "x", "4", "1", "\n", "日", "本", "▁t", "he", "▁the", "th", "ab", "ca", "at", "▁c", "▁cat", "hes", "aa", "aaaa", "日本", "1234", "se", "<s", "▁a"]
    made = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, 0.0, 4) for p in symbols)]
    made += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    made += [(w, -float(i) if kind == 2 else -round(rng.uniform(2, 11), 3), 1) for i, w in enumerate(words) if w not in symbols]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in made)
    trainer = field(3, kind) + (field(35, 1) if byte_fallback else b"") + field(40, 0) + field(41, 1) + field(42, 2) + field(43, 2**32 - 1)
    normaliser = field(1, b"identity") + field(2, charsmap) + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1)
    return out + field(2, trainer) + field(3, normaliser)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("symbols", [(), ("ab",), ("<sep>", "<sep><", "▁▁"), ("日",)])
@pytest.mark.parametrize("squeeze", [False, True])
def test_models_of_both_kinds(kind, byte_fallback, symbols, squeeze):
    """A model loads and agrees with the library on all texts, or is refused."""
    data = model(kind, byte_fallback, symbols, squeeze, prefix=symbols != ("日",))
    codec = pieces.Codec(data)
    rng = random.Random(2)
    signs = ["a", "b", " ", "the", " cat", "<s>", "</s>", "<unk>", "<0x41>", "<sep>", "<sep", "  ", "\n", "日本", "zq", "ü", "▁", "1234", "4"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    ids, ok = codec.encode(texts)
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    for t, x, good in zip(texts, ids, ok, strict=True):
        unknown = 0 in x.tolist()
        assert good == (not unknown)
        assert unknown or codec.decode([x.tolist()]) == [codec.normalised(t)]


def test_refused():
    for kind in (3, 4):
        with pytest.raises(ValueError):
            pieces.Codec(model(kind))


def test_every_text_is_compared(spark):
    """The query's own call compares all texts with the library, wherever they stand in a batch."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "Größe", "日本", "12"]) for _ in range(i % 9)) for i in range(230)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        got = {r.doc_id: r.parity for r in pieces.encode(spark, df.repartition(parts), PATH).collect()}
        assert got == {i: None if t is None else True for i, t in enumerate(texts)}


def test_every_own_piece_is_probed(monkeypatch):
    """A symbol of many, neither among the first nor among the last, that is rebuilt wrongly: the model is refused."""
    data = model(2, symbols=[f"<u{i}>" for i in range(600)])
    pieces.Codec(data)
    real = pieces.Model.build
    lost = lambda self: [(p, s, pieces.UNUSED if p == "<u520>" else kind) for p, s, kind in self.pieces]
    monkeypatch.setattr(pieces.Model, "build", lambda self: real(dataclasses.replace(self, pieces=lost(self))))
    with pytest.raises(ValueError, match="u520"):
        pieces.Codec(data)


def test_bpe_texts_stay_whole(monkeypatch):
    """A BPE model cuts no text into words, which costs CPU time and changes no id, and a codec uses one thread."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    codec = pieces.Codec(pieces.read_model(PATH))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    cut = Tokenizer.from_str(codec.tokenizer.to_str())
    cut.pre_tokenizer = pre_tokenizers.Split(Regex("▁*[^▁]+|▁+"), "isolated")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "é", "\n", "  ", "▁"])
    texts = [" ".join(word() for _ in range(3000)) for _ in range(20)]
    marked = [codec.marked(t) for t in texts]

    def cost(tokenizer):
        began = time.process_time()
        got = [e.ids for e in tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        return time.process_time() - began, got

    runs = [(cost(codec.tokenizer), cost(cut)) for _ in range(5)]
    assert runs[0][0][1] == runs[0][1][1] == codec.library.encode(texts)
    assert min(a for (a, _), _ in runs) < 0.9 * min(b for _, (b, _) in runs)
