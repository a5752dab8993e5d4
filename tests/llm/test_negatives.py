"""Hard negatives against brute force; bounds of the segment summaries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import negatives


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(12)
    for dims in (1, 3, 16, 37, 64):
        x, y = rng.normal(size=(2, 50, dims)) * rng.choice([1, 100], (2, 50, 1))
        (m, d), (n, e) = negatives.summaries(x), negatives.summaries(y)
        block = negatives.Block(np.arange(50), np.arange(50), np.full(50, ""), x, m, d)
        exact, before = x @ y.T, np.inf
        for level in block.levels():
            middle, spread = m[:, level] @ n[:, level].T, d[:, level] @ e[:, level].T
            assert (np.abs(exact - middle) <= spread + 1e-9 * np.abs(x).max() * np.abs(y).max() * dims).all()
            assert spread.sum() <= before * (1 + 1e-9)
            before = spread.sum()


def test_survivors_are_few_where_segments_tell():
    """Vectors that are flat within segments are bounded exactly, so only those of use are scored."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-9, 10, (400, 4)), 16, axis=1).astype(float)
    make = lambda a: negatives.Block(np.arange(len(a)), np.arange(len(a)) + 1000 * len(a), np.full(len(a), "a", object), a, *negatives.summaries(a))
    anchors, rows = make(x[:40]), make(x[40:])
    floor = np.sort(x[:40] @ x[40:].T, axis=1)[:, -5]
    found = [len(i) for i, _, _ in negatives.survivors(anchors, rows, True, lambda i, low, high: high >= floor[i])]
    assert sum(found) <= 40 * 8


def _expected(rows, positives=5, few=10):
    usable = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in usable:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l == label) for i, l, w in usable if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-n, i) for n, i, same in scored if not same and -30 * s <= -100 * n <= -90 * s][:few]
            out += [(a, p, r + 1, i, -s, n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def _rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 41, (6, dims))
    out = []
    for i in range(n):
        c = int(rng.integers(0, 6))
        v = (centres[c] + rng.integers(-20, 21, dims)).astype(float).tolist()
        out.append((int(i), int(c if rng.random() < 0.7 else rng.integers(0, 6)), v))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 3000)  # one or two anchors a round
    rows = _rows(700, 24, 3)
    rows += [(701, 1, rows[100][2]), (702, 2, rows[100][2]), (703, 2, rows[100][2])]  # ties
    rows += [(rows[7][0], 3, rows[9][2]), (300, 4, rows[11][2])]  # repeated ids, one of an anchor
    rows += [(None, 1, rows[0][2]), (800, None, rows[0][2]), (900, 1, None), (904, 1, [None] * 24), (905, 1, [float("inf")] * 24), (906, 1, [float("nan")] * 24),
             (1000, 1, [1.0, 2.0]), (1001, 1, [2.0, 2.0]), (1002, 2, [1.0, 1.0]), (1100, 1, []), (1101, 1, []), (1102, 2, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash")).withColumn(
        "vec", F.lit(1)).withColumn("anchor", F.lit(True)).repartition(5)
    got = sorted(tuple(r) for r in negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0).collect())
    assert got == _expected(rows) and len(got) > 200


def test_fewer_partners_than_asked(spark):
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [10.0, 0.0]), (2, 2, [5.0, 1.0]), (3, 2, [9.0, 0.0]), (4, 2, [10.0, 0.0]), (200, 7, [1.0, 1.0])]
    got = sorted(tuple(r) for r in negatives.hard_negatives(
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 1, 3, 10.0, 9.0), (100, 1, 2, 2, 10.0, 5.0)]


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame([(1, 1, [1.0])], none.schema)
    assert negatives.hard_negatives(some, F.col("vec_id") % 100 == 0).count() == 0
