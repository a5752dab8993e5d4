"""Links between groups of near copies that fill every neighbour list on their own."""

from __future__ import annotations

import numpy as np
import pytest

from labelweave.llm import neighbours


def _groups(sizes, dims=64):
    """Unit vectors with a cosine of 0.99 inside a group, 0.96 between groups, and some that link with nothing."""
    eye, out, at = np.eye(dims), [], 1 + len(sizes)
    for g, n in enumerate(sizes):
        for _ in range(n):
            out.append(np.sqrt(0.96) * eye[0] + np.sqrt(0.03) * eye[1 + g] + np.sqrt(0.01) * eye[at])
            at += 1
    return out + [eye[i] for i in range(at, dims)]


@pytest.mark.parametrize("options", [{}, {"attempts": 1, "min_recall": 2.0}], ids=["lists", "every pair"])
def test_groups_of_near_copies_meet(spark, options):
    sizes = (10, 9, 8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(_groups(sizes))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(vectors, queries=0, **options).collect()}
    n = sum(sizes)
    assert got == {i: (n - 1, 0, i == 0) if i < n else (0, i, True) for i, _ in rows}
    without = neighbours._every_pair(spark.createDataFrame(
        [(i, np.array(v).tobytes(), i) for i, v in rows], "node long, vec binary, component long"), "<f8", 0.95)
    assert without.count() == n * (n - 1) // 2
