from pyspark.sql import functions as F

from labelweave.operators import agreement as A
from labelweave.streaming import flows as S


def as_stream(spark, df, path, files=3):
    df.repartitionByRange(files, "seq").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_labels_arrive_late_and_change(spark, tmp_path):
    rows = [("1", "t", "a", "POS", 0), ("2", "t", "a", "POS", 1), ("1", "t", "b", "NEG", 5), ("2", "t", "b", "POS", 6), ("1", "t", "b", "POS", 9)]
    anns = spark.createDataFrame(rows, "id string, text string, annotator string, label string, seq long")
    out = str(tmp_path / "out")
    S.annotation_stream(as_stream(spark, anns, str(tmp_path / "in")), out).awaitTermination()
    batch = A.latest_annotations(anns, keep=()).select("id", "annotator", "label")
    assert S.current_labels(spark, out).select("id", "annotator", "label").exceptAll(batch).isEmpty()
    pair = ["id", "annotator_a", "label_a", "annotator_b", "label_b"]
    assert S.current_queue(spark, out).select(*pair).collect() == A.disagreements(anns).select(*pair).collect() == []
    labels = {r["id"]: r["label"] for r in S.current_resolution(spark, out).collect()}
    assert labels["2"] == "POS"


def test_relabelled_pairs_leave_and_enter_the_queue(spark, tmp_path):
    rows = [(str(i % 7), "t", who, label, n) for n, (i, who, label) in enumerate(
        [(i, who, ("POS", "NEG", "NEU")[(i * k + len(who)) % 3]) for k in (1, 2, 5) for i in range(14) for who in ("a", "bb", "ccc")])]
    anns = spark.createDataFrame(rows, "id string, text string, annotator string, label string, seq long")
    out = str(tmp_path / "out")
    S.annotation_stream(as_stream(spark, anns, str(tmp_path / "in"), 6), out, buckets=3).awaitTermination()
    pair = ["id", "annotator_a", "label_a", "annotator_b", "label_b"]
    found = sorted(map(tuple, S.current_queue(spark, out).select(*pair).collect()))
    assert found == sorted(map(tuple, A.disagreements(anns).select(*pair).collect())) != []


def test_a_batch_reads_the_state_of_its_own_ids(spark, tmp_path):
    """Twenty batches over growing history: each updates as many keys as it has ids, and the queue is the batch operator's."""
    rows = []
    for b in range(20):
        for i in range(50):
            item = b * 20 + i if i < 25 else (b * 7 + i) % 90  # some ids come back
            rows.append((str(item), "t" * (1 + (b + i) % 4), ("a", "bb", "ccc")[(b + i) % 3], (None, "POS", "NEG", "NEU")[(b * i + item) % 4], len(rows)))
    anns = spark.createDataFrame(rows, "id string, text string, annotator string, label string, seq long")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(anns.schema).option("maxFilesPerTrigger", 1).parquet(source)
    updated = []
    for b in range(20):
        anns.where(f"seq >= {50 * b} and seq < {50 * b + 50}").coalesce(1).write.mode("append").parquet(source)
        query = S.annotation_stream(stream, out)
        query.awaitTermination()
        updated += [(p["stateOperators"][0]["numRowsUpdated"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    ids = [len({r[0] for r in rows[50 * b:50 * b + 50]}) for b in range(20)]
    assert updated == [(n, 50) for n in ids]
    pair = ["id", "text", "annotator_a", "label_a", "annotator_b", "label_b"]
    found = sorted(map(tuple, S.current_queue(spark, out).select(*pair).collect()))
    assert found == sorted(map(tuple, A.disagreements(anns).select(*pair).collect())) != []


def test_row_places_as_order(spark, tmp_path):
    """Places in several files order the rows, not the text of their numbers."""
    rows = [("1", "t", "a", "POS", ("0", "x", 9, 0)), ("1", "t", "a", "NEG", ("0", "x", 10, 0)), ("1", "uu", "b", "POS", ("0", "xx", 1, 0)), ("1", "t", "b", "NEU", ("0", "x", 2, 5))]
    anns = spark.createDataFrame([(*r[:4], (0, r[4][1], r[4][2], r[4][3])) for r in rows],
                                 "id string, text string, annotator string, label string, seq struct<source: int, file: string, pos: long, part: long>")
    out = str(tmp_path / "out")
    S.annotation_stream(as_stream(spark, anns, str(tmp_path / "in"), 2), out).awaitTermination()
    got = S.current_queue(spark, out).collect()
    assert [tuple(r) for r in got] == [("1", "uu", "b", "POS", "a", "NEG")] == [tuple(r) for r in A.disagreements(anns).collect()]
    assert {(r["annotator"], r["pos"]["pos"]) for r in S.current_labels(spark, out).collect()} == {("a", 9), ("b", 2)}


def test_check_and_score(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "POS", 0), ("2", " ", "POS", 1), ("3", "b" * 50, "odd", 2)],
                                 "id string, text string, label string, seq long")
    out = str(tmp_path / "checked")
    S.check_stream(as_stream(spark, rows, str(tmp_path / "in1")), out).awaitTermination()
    assert spark.read.parquet(f"{out}/clean").select("id").collect() == [("1",)]
    assert spark.read.parquet(f"{out}/quarantine").count() == 2
    out = str(tmp_path / "scored")
    S.score_stream(as_stream(spark, rows, str(tmp_path / "in2")), lambda b: b.withColumn("n", F.length("text")), out,
                   max_chars=20).awaitTermination()
    assert spark.read.parquet(f"{out}/scored").count() == 1
    assert {r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()} == {"empty", "too_long"}
