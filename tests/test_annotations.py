import json
import math
import random

import pytest
from pyspark.sql import functions as F

from labelweave.operators import agreement as A
from labelweave.operators import resolve as R
from labelweave.sources import exports
from labelweave.sources import tables as T
from labelweave.sources.documents import read_elements

# The demo annotations, two annotators on seven items.
DEMO = [(1001, "POS", "POS"), (1002, "NEG", "NEG"), (1003, "POS", "NEG"), (1004, "NEU", "POS"), (1005, "NEU", "NEU"),
        (1006, "NEG", "NEG"), (1007, "POS", "NEU")]


@pytest.fixture(scope="module")
def demo(spark):
    rows = []
    for n, (item, a, b) in enumerate(DEMO):
        rows.append((str(item), "text " + str(item), "annotator_a", a, 2 * n))
        rows.append((str(item), "text " + str(item) + ("!" if item == 1007 else ""), "annotator_b", b, 2 * n + 1))
    return spark.createDataFrame(rows, "id string, text string, annotator string, label string, seq long")


def test_agreement_of_demo(demo):
    row = A.agreement_summary(demo).first()
    assert (row["items"], row["agreements"]) == (7, 4)
    assert row["kappa"] == pytest.approx(12 / 33)
    wrong = A.disagreements(demo).orderBy("id").collect()
    assert [r["id"] for r in wrong] == ["1003", "1004", "1007"]
    assert wrong[-1]["text"] == "text 1007!"
    assert A.agreements(demo).count() == 4


def test_resolution_of_demo(demo):
    assert R.resolved_only(R.resolve(demo, "drop_unresolved")).count() == 4
    assert R.resolved_only(R.resolve(demo, "majority")).count() == 4
    by_a = R.resolved_only(R.resolve(demo, "annotator_priority", priority=["annotator_a"])).collect()
    assert {r["id"]: r["label"] for r in by_a} == {str(i): a for i, a, _ in DEMO}
    with pytest.raises(ValueError):
        R.resolve(demo, "coin")


def test_decision_beats_labels_and_last_decision_wins(spark, demo):
    decisions = spark.createDataFrame([("1003", "POS", 0), ("1003", "NEU", 1), ("9", "POS", 2)], "id string, final_label string, seq long")
    out = {r["id"]: r["label"] for r in R.resolved_only(R.resolve(demo, decisions=decisions)).collect()}
    assert out["1003"] == "NEU" and "9" not in out


def test_last_label_wins_and_first_place_stays(spark):
    rows = spark.createDataFrame([("1", "t", "b", "POS", 0), ("1", "t", "a", "NEG", 1), ("1", "t", "b", "NEG", 2)],
                                 "id string, text string, annotator string, label string, seq long")
    assert A.disagreements(rows).count() == 0
    pair = A.agreements(rows).first()
    assert (pair["annotator_a"], pair["annotator_b"]) == ("b", "a")


def test_iaa_rows(spark):
    rows = [("1", "A", "POS", "km"), ("1", "B", "POS", "km"), ("2", "A", "NEG", "en"), ("2", "B", "NEG", "en"),
            ("3", "A", "NEG", "km"), ("3", "B", "POS", "km")]
    anns = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, annotator string, label string, lang string, seq long")
    assert A.kappa_per_pair(anns).first()["kappa"] == pytest.approx(0.4)
    by_lang = {r["lang"]: r["kappa"] for r in A.kappa_per_pair(anns, "lang").collect()}
    assert by_lang["km"] == pytest.approx(0.0) and math.isnan(by_lang["en"])


def test_two_kappas_differ_at_full_chance(spark):
    counts = spark.createDataFrame([("POS", "POS", 5)], "label_a string, label_b string, n long")
    assert A.kappa(counts, mode="adjudication").first()["kappa"] == 1.0
    assert math.isnan(A.kappa(counts, mode="iaa").first()["kappa"])
    assert math.isnan(A.kappa(counts.where("n < 0"), mode="iaa").first()["kappa"])
    stray = counts.unionByName(spark.createDataFrame([("POS", "OTHER", 5)], counts.schema))
    assert A.kappa(stray, mode="adjudication").first()["n"] == 5
    assert A.kappa(stray, mode="iaa").first()["n"] == 10


def test_one_hot_item(spark):
    """One item with many copies of few annotations folds to its annotators."""
    n = spark.range(20_000)
    hot = n.select(F.lit("x").alias("id"), F.lit("same").alias("text"), (F.col("id") % 3).cast("string").alias("annotator"),
                   F.when(F.col("id") % 3 == 0, "POS").otherwise("NEG").alias("label"), F.col("id").alias("seq"))
    assert A.disagreements(hot).count() == 2
    row = R.resolve(hot, "majority").first()
    assert (row["label"], row["text"]) == ("NEG", "same")


LOG = """# Team log, spring
Notes before the first entry are not decisions.
Final Label: POS
* Item ID: k-7
  Reason: irony
  - Final Label: negative
12. ITEM ID: 55
     final   label :  +
- Item ID: k-8
  - Final Label: <choose one>
- Item ID: k-9
  * Final Label: undecided
- Item ID: 55
  - Final Label: neu
- Item ID: 60
  nothing decided yet
"""


def test_log(spark, tmp_path):
    (tmp_path / "log.md").write_text(LOG, encoding="utf-8")
    found = {r["id"]: r["final_label"] for r in exports.read_log(spark, str(tmp_path)).collect()}
    assert found == {"k-7": "NEG", "55": "NEU"}


def test_log_entries_that_cross_blocks(spark, tmp_path):
    """One file in many blocks: an entry's label may stand blocks after its id, and only the first label of an entry counts."""
    text, want = ["intro", "Final Label: NEG"], {}
    for i in range(300):
        text.append(f"{'-*7.'[i % 4]} Item ID: n{i % 90}  (case {i})")
        text += ["  filler " + "x" * (i % 50)] * (i % 7)
        told = ("POS", "neg", "<POS/NEG>", "unclear", "Neutral words")[i % 5]
        text += [f"  - Final Label: {told}"] + ["   Final label : NEU"] * (i % 2)
        if i % 5 < 2:
            want[f"n{i % 90}"] = told.upper()
        elif i % 5 == 4 and i % 2:  # two words are no label, so the next line decides
            want[f"n{i % 90}"] = "NEU"
    (tmp_path / "long.md").write_text("\n".join(text), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = {r["id"]: r["final_label"] for r in exports.read_log(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == want


def _choice(value, **more):
    return {"value": value, **more}


TASKS = [
    {"pk": "p-1", "text": " late train ", "completions": [
        {"created_username": "dara", "results": [_choice({"choices": ["negative"]}, result_type="choices")]}]},
    {"data_id": 31, "data": {"text": "fine"}, "annotations": [
        {"completed_by": {"username": "", "email": "s@example.org"}, "result": [_choice({"labels": ["POS"]}, type="Choices"),
                                                                               _choice({"choices": ["NEG"]}, type="choices")]},
        {"completed_by": 4, "result": [_choice({"choices": "neutral"})]}]},
    {"id": 32, "data": {"text": "no label"}, "annotations": [
        {"completed_by": {"id": 9}, "result": [_choice({"choices": []}, type="choices"), _choice({"rating": 3}, type="rating")]}]},
    {"id": 0, "uuid": "u-2", "data": "odd", "text": "so so", "annotations": [
        {"id": 88, "result": [_choice({"choices": ["+"]}, type="choices")]}, {"result": []}]},
    {"id": 33, "text": "nobody looked"},
]


@pytest.mark.parametrize("wrap", [False, True])
def test_tool_export(spark, tmp_path, wrap):
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"tasks": TASKS} if wrap else TASKS), encoding="utf-8")
    rows = exports.read_annotations(spark, str(path)).select("id", "text", "annotator", "label").orderBy("id", "annotator").collect()
    assert [tuple(r) for r in rows] == [("31", "fine", "4", "NEU"), ("31", "fine", "s@example.org", "POS"), ("p-1", "late train", "dara", "NEG"),
                                        ("u-2", "so so", "88", "POS")]


def test_csv_with_quotes_bom_and_lines(spark, tmp_path):
    path = tmp_path / "anns.csv"
    path.write_text('﻿id,text,annotator,label\n1,"a ""b""\nc",x,positive\n2,t,x,odd\n', encoding="utf-8")
    rows = exports.read_annotations(spark, str(path)).collect()
    assert [(r["id"], r["text"], r["label"]) for r in rows] == [("1", 'a "b"\nc', "POS")]
    with pytest.raises(ValueError):
        T.file_format("x.xlsx")


def test_two_sources_keep_their_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,annotator,label\n1,t,x,POS\n1,t,x,NEG\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "text": "t", "annotations": [
        {"completed_by": "x", "result": [{"value": {"choices": ["NEU"]}}]},
        {"completed_by": "y", "result": [{"value": {"choices": ["POS"]}}]}]}]), encoding="utf-8")
    both = T.combine(exports.read_annotations(spark, str(tmp_path / "a.csv")),
                     exports.read_annotations(spark, str(tmp_path / "b.json"), source_no=1))
    assert both.count() == 4
    assert {r["annotator"]: r["label"] for r in A.latest_annotations(both).collect()} == {"x": "NEU", "y": "POS"}
    pair = A.disagreements(both).first()
    assert (pair["annotator_a"], pair["annotator_b"]) == ("x", "y")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="annotator"):
        T.annotations(spark.createDataFrame([("1", "t", "POS")], "id string, text string, label string"))


def _elements(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        return sorted((r["file"].rsplit("/", 1)[1], r["number"], json.loads(r["element"])) for r in read_elements(spark, str(folder), "tasks").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [64, 777, 1 << 27])
def test_elements_of_one_array_in_many_splits(spark, tmp_path, split):
    """Braces, brackets, quotes and backslashes inside strings; nested objects; keys of the same name elsewhere."""
    rng = random.Random(5)
    odd = ["", "}", "{", "a } b", "[x]", "\\", "\\\"", '"', '"}', "\\\\", "tasks", '"tasks": [', "é ខ្មែរ", "line\nbreak"]
    tasks = [{"id": i, "data": {"text": rng.choice(odd) + rng.choice(odd)}, "annotations": [{"r": [rng.choice(odd)], "n": {}} for _ in range(rng.randint(0, 3))]}
             for i in range(120)]
    other = {"meta": {"tasks": [{"no": 1}], "tags": ["]", "}"]}, "note": '"tasks": [', "tasks": tasks, "later": [{"no": 2}], "end": {"x": [{}]}}
    (tmp_path / "a.json").write_text(json.dumps(tasks, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(tasks, separators=(",", ":"), ensure_ascii=False), encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps(other, indent=2), encoding="utf-8")
    (tmp_path / "d.json").write_text(json.dumps(other, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "e.json").write_text("[]", encoding="utf-8")
    (tmp_path / "f.json").write_text('{"tasks": [], "more": [{"no": 3}]}', encoding="utf-8")
    (tmp_path / "g.json").write_text('{"other": [{"no": 4}]}', encoding="utf-8")
    (tmp_path / "h.json").write_text("[\n]", encoding="utf-8")
    want = [(f"{name}.json", i, t) for name in "abcd" for i, t in enumerate(tasks)]
    assert _elements(spark, tmp_path, split) == want


@pytest.mark.parametrize("wrap", [False, True])
def test_export_document_is_read_by_many_tasks(spark, tmp_path, wrap):
    many = [{**t, "uuid": f"u-{i}"} for i in range(40) for t in TASKS]
    (tmp_path / "x.json").write_text(json.dumps({"tasks": many} if wrap else many), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        once = exports.read_tool_export(spark, str(tmp_path / "x.json"))
        rows = once.groupBy("annotator", "label").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(t) for t in many), encoding="utf-8")
    lines = exports.read_tool_export(spark, str(tmp_path / "lines.json"), lines=True).groupBy("annotator", "label").count().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, lines)) != []
