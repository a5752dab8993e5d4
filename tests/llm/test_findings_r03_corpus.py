"""Findings of round 3 on the corpus operators and their pipeline."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import GroupedData

from labelweave.llm import jaccard, secrets


def test_words_of_the_dictionary_do_not_multiply_in_plans(spark):
    words = ["".join(chr(97 + i // k % 26) for k in (1, 26, 676)) for i in range(2_000)]
    rows = secrets.with_features(secrets.planted(spark, words, 200), words)
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 60_000  # 300,000 and more, with a node for each word and use
    assert rows.count() > 150
    odd = ['a b', 'q"u', "back\\slash", "line\nend"]
    assert spark.range(1).select(secrets._word_list(odd)).first()[0] == odd
    assert spark.range(1).select(secrets._word_list([])).first()[0] == []


def _members(rows, regions, held):
    return [(region, row, 100, row, bytes(jaccard.SKETCH_BITS // 8), None, held) for row in rows for region in regions]


def test_a_pair_of_a_crowded_region_is_made_once(spark, monkeypatch):
    made, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: made.append(apply(self, f, schema)) or made[-1])
    rows = _members(range(12), range(-15, 15), 12) + _members((20, 21), range(100, 121), 2) + _members((30, 31), range(200, 205), 2)
    rows += _members((40, *range(51, 55)), range(300, 310), 5) + _members((40, *range(61, 65)), range(310, 312), 5)  # beyond what 40 knows
    members = spark.createDataFrame(rows, "region long, row long, n long, component long, sketch binary, wide binary, _held long")
    got = sorted(map(tuple, jaccard._left_pairs(members, 12).collect()))
    groups = range(12), (20, 21), (40, *range(51, 55)), (40, *range(61, 65))  # 30 and 31 share too few regions
    want = sorted({p for g in groups for p in combinations(g, 2)})
    assert got == want
    crowded = made[0].where("a < 20 or a >= 40")
    assert crowded.count() <= len(want) - 1 + 4  # a row for each pair and bucket before; those of 40 with 61 to 64 may come twice
