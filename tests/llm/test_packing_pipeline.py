"""Packing: exact ids, no padding, each id in one piece. The pipeline, stage by stage, against plain code."""

import collections
import importlib
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from labelweave.llm import packing, quality, secrets
from labelweave.llm.common import read, settle
from labelweave.llm.queries import QUERIES

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizer(spark, sf_dir):
    texts = [r.text for r in read(spark, sf_dir, "documents").collect()] + [
        "", "it's don't '' <|endoftext|> x<|startoftext|>y 12ab Á µ a\x1cb  　 İΣΑΣ σς ﬁ", "..!!..", "ÀÉß×÷", "a" * 5000, "é ́a"]
    plain, ours = Tokenizer.from_file(WORD), packing.WordIds(WORD, np.dtype("<u2"))
    for text, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours.ids(text), "<u2").tolist() == e.ids


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = "Some words, of a text!\n" * 500
    whole = packing.WordIds(WORD, np.dtype("<u2")).ids(text)
    monkeypatch.setattr(packing, "BLOCK", 37)
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    assert packing.WordIds(WORD, np.dtype("<u2")).ids(text) == whole


def test_hilbert_steps_are_neighbours():
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    key = packing.hilbert_index(cells, 3)
    assert sorted(key) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)) == {1}


@pytest.mark.parametrize("tape", [0, 1, 7, 8, 21, 64])
def test_tail_is_powers_of_two(tape):
    at, pieces = 0, []
    for n in [5, 1, 30, 2, 100]:
        n = min(n, tape - at)
        pieces += packing.cut_pieces(at, n, tape, 8)
        at += n
    sizes = collections.defaultdict(int)
    for _, n, sequence, offset in pieces:
        assert sizes[sequence] == offset
        sizes[sequence] += n
    assert sum(sizes.values()) == at and (at < tape or all(n & (n - 1) == 0 for n in sizes.values()))


def test_pack(spark, sf_dir):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "same"), (-3, "same"), (-4, "word " * 30_000)], "doc_id long, text string")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd).withColumn("key", F.lit("clash"))
    out = packing.pack(docs, WORD, 2048, 1).collect()
    plain = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(r.doc_id, len(ids))] += 1
    got = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got[(r.doc_id, r.doc_tokens)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: n * k[1] for k, n in want.items()} == dict(got)
    for rows in sequences.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    long = sorted((r.start, bytes(r.ids)) for r in out if r.doc_id == -4)
    assert np.frombuffer(b"".join(x for _, x in long), "<u4").tolist() == plain.encode("word " * 30_000, add_special_tokens=False).ids + [1]
    assert packing.pack(docs.limit(0), WORD).count() == 0
    wide = packing.sequences(packing.pack(docs.where("doc_id > 190"), BYTE, 64, 50256))
    assert wide.where("length(ids) > 256").count() == 0 and wide.count() > 1


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "packing"]
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 3 = 0")
    stages = dict(corpus_pipeline.STAGES)
    kept = settle(stages["quality rules"](spark, docs, "/root/testdata/sf0.01"), "t")
    assert kept.columns == docs.columns
    rules = quality.learn(docs, read(spark, "/root/testdata/sf0.01", "labels"))
    assert sorted(r.doc_id for r in quality.judge(docs, rules).where("kept").collect()) == sorted(r.doc_id for r in kept.collect())
    alone = settle(stages["n-gram Jaccard join"](spark, kept, sf_dir), "t")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: (lambda w: frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)))
    sets = {r.doc_id: cut(r.text) for r in kept.collect()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i in sets if root(i) == i)
    clean = settle(stages["suffix-array dedup"](spark, alone, sf_dir), "t")
    assert clean.columns == docs.columns and clean.count() == alone.count()
    assert clean.agg(F.sum("n_chars")).first()[0] < alone.agg(F.sum("n_chars")).first()[0]
    masked = settle(stages["secret scans"](spark, clean, sf_dir), "t")
    assert masked.count() == clean.count() and masked.where(F.col("text").rlike("[0-9a-f]{40}")).count() == 0
    assert masked.where(F.col("text").contains(secrets.MASK)).count() == clean.where(F.col("text").rlike("(?i)token = \"[0-9a-f]{40}\"")).count()
    packed = stages["packing"](spark, masked, sf_dir)
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_lives_without_this_subpackage(monkeypatch):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "op1_chat_formatting" in __spark_entry__.queries()
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("labelweave.llm", "corpus_pipeline")) else sys.modules.get(name))
    assert "pipeline" not in __spark_entry__.queries() and "metrics_by_lang" in __spark_entry__.queries()
