"""Line dedup: the perfect hash and the rows it gives, against a dictionary of lines."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import lines

LOW = -(1 << 63)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_numbers_every_key_once(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, (n, 2), dtype=np.uint64), axis=0)
    hashed = lines.PerfectHash.build(keys[:, 0], keys[:, 1])
    assert sorted(hashed.numbers(keys[:, 0], keys[:, 1]).tolist()) == list(range(len(keys)))
    assert len(hashed.bits) * 64 <= 6 * n + 64 * 40


def test_index_tells_foreign_keys_apart():
    rng = np.random.default_rng(1)
    own, other = rng.integers(0, 1 << 64, (2, 4000, 2), dtype=np.uint64)
    ids = rng.integers(-5, 5, 4000)
    twice = [np.concatenate([a, a[:1000]]) for a in (own[:, 0], own[:, 1], ids)]
    twice[2][4000:] += 7
    index = lines.LineIndex.build(*twice[:2], twice[2], twice[2], np.ones(5000, np.int64))
    index = lines.LineIndex.of_row({k: v[0] for k, v in index.row(3).items()})
    count, owner = index.probe(own[:, 0], own[:, 1])
    assert (count == np.where(np.arange(4000) < 1000, 2, 1)).all() and (owner == ids).all()
    assert not index.probe(other[:, 0], other[:, 1])[0].any()


def _expected(rows):
    holders = defaultdict(set)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(fold)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(LOW if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        own = LOW if doc_id is None else doc_id
        kept = [x for x in all_lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    pool = [f"{rng.choice(['  ', '', chr(9)])}Line number {i} {'of the pool' * rng.randint(0, 2)}{rng.choice(['', ' ', chr(13)])}" for i in range(60)]
    pool += ["short", "ninechars", "tenchars10", "Ünïcödé x", "ÜNÏCÖDÉ lines", "", " ", " no break space ", "x" * 30_000]
    out = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    return out + [(None, "the line of no id\nLine number 3 "), (900, "the line of no id"), (901, None), (902, ""), (903, "\n\n"), (5, pool[1] + "\n" + pool[1]),
                  (5, pool[1]), (904, "y" * 100_000 + "\n" + pool[2]), (-3, "Line number 7")]


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, rows, small, monkeypatch):
    if small:  # many batches and shards; the workers read these from the closure
        monkeypatch.setattr(lines, "SHARD_BYTES", 4096)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n_lines", F.lit(0)).repartition(7)
    got = [tuple(r) for r in lines.drop_repeated_lines(docs).collect()]
    key = lambda r: (r[0] is not None, *r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(_expected(rows), key=lambda r: str(key(r)))
    assert sum(r[2] for r in got) > 500


def test_no_rows(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
