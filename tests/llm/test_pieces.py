"""Unigram Viterbi: against the public library on a model made here, and against a plain search."""

import itertools
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelweave.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def write_model(path, words):
    """A unigram model file with byte fallback: pieces and scores as given."""
    entry = lambda t, s, k: _field(1, _field(1, t.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k))
    data = entry("<unk>", 0.0, pieces.UNKNOWN) + entry("<s>", 0.0, pieces.CONTROL) + entry("</s>", 0.0, pieces.CONTROL)
    data += b"".join(entry(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256))
    data += b"".join(entry(t, s, pieces.NORMAL) for t, s in words.items())
    data += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    rng = random.Random(1)
    syllables = ["a", "b", "é", "th", "the", "he", "ou", "▁", "▁t", "▁th", "▁the", "▁a", "ab", "▁ou", "oua", "漢", "漢字", "▁▁", "字a"]
    words = {s: -rng.uniform(1, 9) for s in syllables}
    for a, b in itertools.product("abtheou", repeat=2):
        words.setdefault(a + b, -rng.uniform(2, 12))
    return write_model(tmp_path_factory.mktemp("model") / "small.model", words)


def test_equals_the_library(small):
    ours, theirs = pieces.Pieces(small), sentencepiece.SentencePieceProcessor(model_file=small)
    rng = random.Random(2)
    texts = ["", " ", "the ou", "a  b", "  lead", "x\n\ty", "漢字a漢", "\x01z"] + [
        "".join(rng.choice(["a", "b", "t", "h", "e", "o", "u", " ", "é", "漢", "字", "q", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text, ids in zip(texts, ours.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text), text
        assert ours.decode(ids) == text


def _best(p, text):
    data, score = text.encode(), {}
    for i, t in enumerate(p.texts):
        if p.kinds[i] == pieces.NORMAL:
            score[t] = p.score[i]
    best = [-math.inf] * (len(text) + 1)
    best[0] = 0.0
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            s = score.get(piece, p.unknown if end - start == 1 else -math.inf)
            best[end] = max(best[end], best[start] + s)
    return best[-1], data


def test_best_sum_on_the_public_model():
    p = pieces.model(MODEL)
    for text in ("the of and then", "Ouinglyon ththat", "héé 漢字 zz", "x" * 40):
        ids = np.frombuffer(p.encode_all([text])[0], "<u4").tolist()
        total, at = 0.0, 0
        marked = "▁" + text.replace(" ", "▁")
        run = b""
        for i in ids:
            if p.kinds[i] == pieces.BYTE:
                run += p.bytes[i]
            else:
                total += p.score[i]
        total += p.unknown * len(run.decode())
        assert total == pytest.approx(_best(p, marked)[0])
        assert at == 0 and p.decode(p.encode_all([text])[0]) == text


def test_long_and_short_chunks_agree():
    p = pieces.model(MODEL)
    for text in ("▁hello", "▁漢字x\x01", "e" * 200, "é" * 90):
        assert p.segment_one(text.encode()) == p.segment_many([text.encode()])[0]


def test_rows(spark):
    rows = spark.createDataFrame([(1, "the the", 5), (1, "the the", 5), (2, None, 6), (None, "", 7), (3, "a " * 50_000, 8)], "doc_id long, text string, ids int")
    out = pieces.round_trip(rows, MODEL).collect()
    assert len(out) == 5 and all(r.round_trip for r in out)
    assert {r.n_pieces for r in out if r.doc_id in (2, None)} == {0}
    back = pieces.decode(pieces.encode(rows, MODEL), MODEL).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "") for r in rows.collect())
    assert pieces.round_trip(rows.limit(0), MODEL).count() == 0
