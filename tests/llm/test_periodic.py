"""Lyndon arrays and runs of words against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import periodic


def _lyndon(words):
    """Distance to the next smaller suffix."""
    n, out = len(words), []
    for i in range(n):
        j = i + 1
        while j < n and words[i:] < words[j:]:
            j += 1
        out.append(j - i)
    return out


def _runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _samples(rng, count):
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 3, 5]), rng.randint(1, 40)
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.6:
            p, b = rng.randint(1, 5), rng.randint(0, 5)
            words = words[:b] + [words[(b + i % p) % n] for i in range(rng.randint(0, 50))] + words[b:]
        yield words


def test_lyndon_arrays_under_both_orders():
    for words in _samples(random.Random(11), 1500):
        a = np.array(words, np.int64)
        assert periodic.lyndon_array(a).tolist() == _lyndon(words)
        assert periodic.lyndon_array(-a).tolist() == _lyndon([-w for w in words])


def test_runs_and_the_stretches_that_hold_them():
    some = 0
    for words in _samples(random.Random(12), 3000):
        a, want = np.array(words, np.int64), _runs(words)
        assert periodic.runs_of(a) == want
        kept = [(s + x, n, q) for x, y in zip(*periodic.stretches(a, np.zeros(len(a), np.int64))) for s, n, q in periodic.runs_of(a[x:y])]
        assert sorted(kept, key=lambda r: (r[0], r[2])) == want
        some += bool(want)
    assert some > 800


def test_long_periods_and_far_repeats():
    rng = np.random.default_rng(0)
    unit = rng.integers(0, 3000, 4000)
    assert periodic.runs_of(np.tile(unit, 5)) == [(0, 20_000, 4000)]
    far = np.concatenate([unit, rng.integers(0, 3000, 30_000), unit, unit])
    assert not len(periodic.stretches(far, np.zeros(len(far), np.int64))[0]) and periodic.runs_of(far[-8000:]) == []


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(13), [(None, "b a " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (6, "É é " * 4 + "end"),
                                   (7, "a b c " * 5), (8, "w" * 70_000 + " q r" * 40)]
    for k, words in enumerate(_samples(rng, 300)):
        out.append((100 + k, rng.choice([" ", "\n", "\t  "]).join(f"w{w}" for w in words)))
    return out


def test_rows_of_documents(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)).repartition(3)
    got = periodic.word_runs(docs).withColumn("best", periodic.strongest(F.col("runs"))).collect()
    want = []
    for doc_id, text in texts:
        words = (text or "").encode().split()
        runs = _runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((doc_id, len(words), runs, " ".join(w.decode() for i, w in enumerate(words) if i not in gone), best))
    key = lambda r: (r[0] is not None, r[0], r[1])
    mine = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, tuple(r.best) if r.best else None) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert sum(len(r[2]) for r in want) > 100


def test_no_documents(spark):
    assert periodic.word_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digests(spark, sf_dir):
    from labelweave.llm import queries

    rows = queries.op11_periodic_runs(spark, sf_dir).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all((r.n_runs == 0) == (r.start is None) == (r.runs_sha256 == empty) for r in rows) and any(r.n_runs for r in rows)
    assert all(r.exponent_milli == 1000 * r.length // r.period for r in rows if r.n_runs)
