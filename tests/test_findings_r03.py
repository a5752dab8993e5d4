"""Inputs of the third round's findings."""

import json
import random
import re
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.catalog import QUERIES, flows
from labelweave.operators import explain as E
from labelweave.operators import features, gram_arrays, models
from labelweave.operators import ngrams as G
from labelweave.operators import ordering as O
from labelweave.session import scratch_path, shared_dir
from labelweave.sources import documents


@pytest.mark.parametrize("files", [0, 3])
def test_stream_reads_a_file_or_a_folder(spark, sf_dir, tmp_path, files):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if files:
        table.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        (tmp_path / "documents.parquet").symlink_to(f"{sf_dir}/documents.parquet")
    assert QUERIES["stream_score"](spark, str(tmp_path)).count() == table.count()


def test_equal_outputs_of_a_plugged_in_model_go_to_the_first_column(spark):
    near = np.nextafter(0.15, 1)
    outputs = {"tie": [0.15, 0.15, 0.1], "near": [0.15, near, 0.1], "last": [0.1, 0.2, near + 0.1]}
    rows = spark.createDataFrame([(k,) for k in outputs], "text string")
    make = lambda: lambda texts: np.array([outputs[t] for t in texts])
    got = {r["text"]: r["pred_label"] for r in models.score_with(rows, make, ("POS", "NEG", "NEU")).collect()}
    assert got == {"tie": "POS", "near": "NEG", "last": "NEU"}


@pytest.mark.parametrize("bits", [63, 40])
def test_gram_counts_by_brute_force(monkeypatch, bits):
    monkeypatch.setattr(gram_arrays, "BITS", bits)
    draw = random.Random(bits)
    wide = "".join(chr(c) for c in range(0x4E00, 0x5600)) + "\x00\U0001f600\U0010ffff"
    for letters, (low, high) in (("ab", (1, 3)), ("abc\x00\xe9", (3, 5)), (wide, (2, 3)), (wide, (4, 12))):
        texts = ["".join(draw.choice(letters) for _ in range(n)) for n in (0, 1, 2, 5, 40, 7)]
        owner = np.array([0, 0, 1, 1, 2, 1])
        want = Counter((o, t[i:i + n]) for o, t in zip(owner.tolist(), texts) for n in range(low, high + 1) for i in range(len(t) - n + 1))
        got = {}
        for grams, of, gram, tf in gram_arrays.gram_counts(texts, low, high, owner):
            names = grams.to_pylist()
            got |= {(int(o), names[g]): int(n) for o, g, n in zip(of, gram, tf)}
        assert got == dict(want)


ODD = [(1, "abab \x00 the cat"), (2, "the  cat sat"), (2, "on the mat"), (3, None), (4, ""), (None, "the cat"), (5, "zz \U0001f600 the"), (6, "the mat the mat")]


def test_tfidf_of_rare_ngrams_joins_them_as_rows(spark):
    """However many n-grams tasks hold, the weights are the same; texts of one id count as one."""
    df = spark.createDataFrame(ODD, "id long, text string")
    read = lambda held: {(r["id"], r["gram"]): (r["tf"], round(r["weight"], 12)) for r in G.tfidf(df, 2, 3, 2, held=held).collect()}
    whole = read(1000)
    assert whole == read(5) == read(0) and whole[(6, "the")][0] == 2 and len({k for k, _ in whole}) == 5


def test_ngram_rows_do_not_leave_their_task(spark):
    df = spark.createDataFrame([(i, "the cat sat") for i in range(20)], "id long, text string")
    plan = G.tfidf(df, 2, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gram" not in plan and "Window" not in plan


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame([(str(i), f"{t} {i % 3}", "POS" if i % 2 else "NEG") for i, (_, t) in enumerate(ODD * 6)], "id string, text string, label string")
    rows = rows.fillna("")
    fitted = features.fit_features(rows.withColumnRenamed("text", "_norm"), 2, 3, 2)
    weights = fitted.index.selectExpr("gram AS feature", "inline(array(struct('POS' AS label, length(gram) - 2.5 + ascii(gram) / 500 AS weight), struct('NEG' AS label, 0.01D AS weight)))")
    model = models.with_weights(fitted, ["NEG", "POS"], weights)
    return model, model.score(rows)


def test_explanations_are_those_of_the_joined_weights(scored):
    model, rows = scored
    for explain in (E.explain_misclassified, E.importance_of_prediction):
        here, joined = (explain(rows, model, 2, 3, 4, held=h).drop("logits", "proba", "normalized_text") for h in (10_000, 0))
        columns = sorted(here.columns)
        texts = [sorted(str(r).replace("-0.0000", "0.0000") for r in d.select(columns).selectExpr(*columns).collect()) for d in (here, joined)]
        assert len(texts[0]) > 5
        assert [t[:60] for t in texts[0]] == [t[:60] for t in texts[1]]


def test_explained_rows_stay_where_they_are(scored):
    model, rows = scored
    plan = E.importance_of_prediction(rows, model, 2, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_a_vocabulary_beyond_a_small_table_is_looked_up_in_tasks(spark):
    """More columns than a broadcast table may have rows: texts still meet a copy of the index, with the vectors of the join."""
    draw = random.Random(7)
    texts = ["".join(chr(0x4E00 + draw.randrange(20_000)) for _ in range(2_600)) for _ in range(22)] + ["", None, "\u4e00  x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, _norm string").withColumn("none", F.lit(None))
    fitted = features.fit_features(rows, 2, 3, 1)
    assert 100_000 < fitted.size and fitted.held
    entries = lambda f: {r["id"]: (r["none"], r["features"].size, r["features"].indices.tolist(), r["features"].values.round(9).tolist())
                         for r in f.transform(rows).collect()}
    held, joined = entries(fitted), entries(replace(fitted, held=False))
    assert held == joined and len(held) == 25 and held[23][2] == []
    assert fitted.transform(rows, ["id"]).columns == ["id", "features"]


def test_texts_are_counted_once_for_an_index(spark):
    rows = spark.createDataFrame([(f"the cat sat on mat {i}",) for i in range(30)], "_norm string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fitted = features._write_index(rows.select(read("_norm").alias("_norm")), 2, 3, 2, 30, "vocabulary", 0, "_norm", scratch_path(spark, "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert fitted > 30 and seen.value == 30


def test_last_rows_order_places_only(spark):
    """The edge is found on row numbers; texts are not gathered to be ordered. Copies of a row number are counted off."""
    rows = spark.createDataFrame([(i, i - i % 3, "t" * 5) for i in range(100)], "id long, seq long, text string")
    kept = O.last_rows(rows, 0.25)
    assert kept.count() == 25 and {r["seq"] for r in kept.collect()} == set(range(75, 100, 3)) and kept.columns == rows.columns
    assert O.last_rows(rows, 0.05).count() == 5
    plan = O.last_rows(rows, 0.25)._jdf.queryExecution().analyzed().toString().splitlines()
    by_place = [line for line in plan if "row_number" in line and "Window" in line and "_seq" in line]
    assert by_place and not any("text" in line for line in by_place)


def test_streamed_tables_come_in_bounded_files(spark):
    """A column of few values does not decide how many files a stream has."""
    rows = spark.range(1000).selectExpr("id AS seq", "'x' AS label")
    flows._as_stream(spark, rows, "bounded", by="label")
    assert len(rows.repartitionByRange(4, "label").rdd.glom().filter(len).collect()) == 1
    newest = max(Path(shared_dir(spark)).glob("labelweave/bounded-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(newest.glob("part-*.parquet"))) >= 4


def test_places_of_elements_are_found_without_their_texts(spark, tmp_path, monkeypatch):
    """Elements that go over the ends of several splits are whole, and what is counted beforehand never reads the text."""
    tasks = [{"id": i, "text": "x } [" * (i % 7 * 40), "a": [{}]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps({"tasks": tasks}), encoding="utf-8")
    counted, small = [], documents.broadcast_if_small
    monkeypatch.setattr(documents, "broadcast_if_small", lambda df: counted.append(df._jdf.queryExecution().executedPlan().toString()) or small(df))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = documents.read_elements(spark, str(tmp_path), "tasks").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r["element"]) for r in sorted(found, key=lambda r: r["number"])] == tasks
    scans = [re.findall(r"InMemoryTableScan \[([^]]*)\]", plan) for plan in counted]
    assert len(scans) >= 5 and all(scans) and not any("value#" in columns for plan in scans for columns in plan)
