"""Readers and writers: Spark writes a derived table, the reader under test reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.agreement import DECISIONS, LATEST, _logged, _sql_pairs
from labelweave.catalog.metrics import rounded, sql_summary
from labelweave.catalog.registry import ORACLES, QUERIES, query
from labelweave.catalog.views import LABEL_AT, annotations, documents, draw, labelled, predictions, raw_rows, sql_draw, with_text, with_views
from labelweave.operators import metrics as M
from labelweave.operators.agreement import disagreements
from labelweave.operators.calibration import reliability_bins
from labelweave.session import scratch_path
from labelweave.sinks import tables as sinks
from labelweave.sources import exports, runs
from labelweave.sources import tables as T


def _through(spark, df, name, fmt="csv", **read):
    path = scratch_path(spark, name) + (f".{fmt}" if fmt == "csv" else "")
    sinks.write_table(df, path, fmt)
    return T.read_table(spark, path, fmt, **read)


@query("scan_labelled", with_views("raw_rows", """
    SELECT id, text, upper(trim(label)) AS label, nullif(trim("group"), '') AS "group", nullif(trim(lang), '') AS lang,
           nullif(trim(split), '') AS split FROM raw_rows"""))
def scan_labelled(spark, sf):
    return T.labelled(_through(spark, raw_rows(spark, sf).drop("seq"), "labelled", "parquet"), source=None)


@query("scan_labelled_csv", with_views("labelled", """
    SELECT CAST(id AS VARCHAR) AS id, text, label, "group", lang FROM labelled"""))
def scan_labelled_csv(spark, sf):
    return T.labelled(_through(spark, labelled(spark, sf).drop("seq"), "labelled"), split=None, source=None)


@query("scan_splits", with_views("raw_rows", """
    SELECT seq, lower(trim(split)) AS split FROM raw_rows WHERE lower(trim(split)) IN ('train', 'val', 'test')"""))
def scan_splits(spark, sf):
    rows = raw_rows(spark, sf).withColumn("split", F.when(F.col("split") == "val", "Validation").otherwise(F.col("split")))
    return T.with_known_split(_through(spark, rows, "splits", "parquet")).select("seq", "split")


@query("scan_split_files", with_views("labelled", """SELECT CAST(id AS VARCHAR) AS id, text, label, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM labelled"""))
def scan_split_files(spark, sf):
    rows, paths = labelled(spark, sf), []
    for i in range(3):
        paths.append(scratch_path(spark, f"part{i}"))
        sinks.write_table(rows.where(F.col("id") % 3 == i).drop("seq"), paths[-1])
    return T.read_split_files(spark, *paths).select("id", "text", "label", "split")


def _typed_annotations(spark, sf):
    n = draw("typed", "seq")
    label = (F.when(n % 50 == 0, "unsure").when((n % 3 == 0) & (F.col("label") == "POS"), " positive")
             .when((n % 3 == 0) & (F.col("label") == "NEG"), "-").when((n % 3 == 0) & (F.col("label") == "NEU"), "0")
             .otherwise(F.lower("label")))
    return annotations(spark, sf).withColumn("label", label)


@query("scan_annotations", with_views("annotations", f"""
    SELECT CAST(id AS VARCHAR) AS id, trim(text) AS text, annotator, label, count(*) AS n FROM annotations WHERE {sql_draw('typed', 'seq')} % 50 <> 0 GROUP BY ALL"""))
def scan_annotations(spark, sf):
    rows = _through(spark, _typed_annotations(spark, sf).select("id", "text", "annotator", "label"), "annotations", with_seq=True)
    return T.annotations(rows).groupBy("id", F.trim("text").alias("text"), "annotator", "label").agg(F.count(F.lit(1)).alias("n"))


@query("scan_tool_export", with_views("annotations", "SELECT CAST(id AS VARCHAR) AS id, trim(text) AS text, annotator, label FROM annotations"))
def scan_tool_export(spark, sf):
    """One task per annotation, in the spellings exports use, as JSON lines."""
    rows = annotations(spark, sf)
    k = F.col("seq") % 10
    choice = F.struct(F.lit("choices").alias("type"), F.struct(F.array("label").alias("choices")).alias("value"))
    named = F.struct(F.lit("Choices").alias("result_type"), F.struct(F.array("label").alias("labels")).alias("value"))
    person = F.struct(F.col("annotator").alias("username"), F.lit("x@example.org").alias("email"))
    newer = F.to_json(F.struct("id", F.struct("text").alias("data"), F.array(F.struct(
        person.alias("completed_by"), F.array(choice).alias("result"))).alias("annotations")))
    older = F.to_json(F.struct(F.col("id").cast("string").alias("task_id"), "text", F.array(F.struct(
        F.col("annotator").alias("completed_by"), F.array(named).alias("results"))).alias("completions")))
    # The number 0 counts as missing in exports, so that id is written as text.
    path = scratch_path(spark, "export")
    lines = rows.select(F.when((k % 2 == 0) & (F.col("id") != 0), newer).otherwise(older).alias("value"))
    lines.write.mode("overwrite").text(path)
    return exports.read_tool_export(spark, path, lines=True).select("id", "text", "annotator", "label")


@query("scan_log", with_views("labelled", "SELECT CAST(id AS VARCHAR) AS id, final_label FROM decisions", decisions=DECISIONS))
def scan_log(spark, sf):
    n = draw("entry", "id")
    rows = _logged(spark, sf).select(
        F.concat(F.when(n % 2 == 0, "- Item ID: ").otherwise("12. Item  ID: "), F.col("id").cast("string"), F.lit("\n  - Rationale: x\n  * Final  Label : "),
                 F.when(n % 3 == 0, F.lower("final_label")).otherwise(F.col("final_label")),
                 F.lit("\n- Item ID: "), F.col("id").cast("string"), F.lit("\n  - Final Label: <POS/NEG/NEU>")).alias("value"))
    path = scratch_path(spark, "log")
    rows.write.mode("overwrite").text(path)
    return exports.read_log(spark, path).select("id", "final_label")


@query("scan_groups", with_views("labelled", """SELECT CAST(id AS VARCHAR) AS id, "group" || '!' AS "group" FROM labelled"""))
def scan_groups(spark, sf):
    rows = labelled(spark, sf, text=False).select("id", "group", "seq")
    later = rows.select("id", F.concat("group", F.lit("!")).alias("group"), (F.col("seq") + 10_000_000_000).alias("seq"))
    blank = rows.select(F.lit(None).cast("long").alias("id"), "group", "seq")
    return T.group_map(_through(spark, rows.unionByName(later).unionByName(blank), "groups", "parquet"))


@query("scan_final", with_views("raw_rows", "SELECT seq, id, upper(trim(label)) AS label FROM raw_rows WHERE trim(id) <> '' AND trim(label) <> ''"))
def scan_final(spark, sf):
    return T.final_dataset(_through(spark, raw_rows(spark, sf), "final", "parquet")).select("seq", "id", "label")


@query("scan_predictions", with_views("predictions_a", "SELECT CAST(id AS VARCHAR) AS id, label, pred_label FROM predictions_a"))
def scan_predictions(spark, sf):
    rows = predictions(spark, sf).select(F.col("id").alias("ID"), F.lower("label").alias("Label"), F.col("pred_label").alias("PRED_Label"), "lang")
    return T.predictions(_through(spark, rows, "predictions"))


@query("scan_categories", with_views("labelled", """SELECT "group" AS category, count(*) AS n FROM labelled GROUP BY category
    UNION ALL SELECT 'overall', count(*) FROM labelled"""))
def scan_categories(spark, sf):
    rows = _through(spark, labelled(spark, sf).drop("seq"), "categories")
    both = T.categorised(rows, "group").unionByName(T.categorised(rows))
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("scan_inference", "SELECT CAST(doc_id AS VARCHAR) AS id, text, lang FROM documents")
def scan_inference(spark, sf):
    return T.inference(_through(spark, documents(spark, sf).select("id", "text", "lang"), "inference"))


@query("scan_corpus_lines", """
    SELECT line AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents
      UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) GROUP BY line""")
def scan_corpus_lines(spark, sf):
    paths = []
    for name in ("documents", "conversations"):
        paths.append(scratch_path(spark, name))
        spark.read.parquet(f"{sf}/{name}.parquet").select("text").write.text(paths[-1])
    return T.corpus_from_text(spark, paths).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _run_documents(spark, sf):
    """A metrics document per source, computed from the predictions: val from one model, test from the other."""
    path = scratch_path(spark, "models")
    val, test = [M.summary(M.count_table(predictions(spark, sf, m), ["group"]), ["group"]) for m in "ab"]
    langs = M.summary(M.count_table(predictions(spark, sf, "b"), ["group", "lang"]), ["group", "lang"]).groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("f1_macro__"), "lang"), "f1_macro"))).alias("by_lang"))
    rows = (val.select("group", F.struct("accuracy", "f1_macro").alias("val"))
            .join(test.select("group", F.struct(F.col("accuracy").cast("string").alias("eval_accuracy"),
                                                F.col("f1_macro").alias("eval_f1_macro")).alias("test"), "n"), "group").join(langs, "group"))
    doc = F.to_json(F.struct("val", "test", F.struct(F.col("by_lang").alias("test")).alias("per_language"),
                             F.struct(F.struct(F.lit(0.25).alias("ece"), F.col("n").alias("n_samples")).alias("test")).alias("calibration"),
                             F.struct(F.col("n").alias("train")).alias("sizes"), F.struct(F.lit("platt").alias("calibrate")).alias("params")))
    rows.select(F.col("group").alias("model"), doc.alias("value")).write.partitionBy("model").text(path)
    return path


def _runs(spark, sf):
    docs = runs.read_runs(spark, [_run_documents(spark, sf)], pattern="part-[^/]*")
    return docs.withColumn("model", F.regexp_extract("model", "model=([^/]+)$", 1))


_BY_GROUP = {"va": sql_summary("predictions_a", '"group"'), "te": sql_summary("predictions_b", '"group"')}


@query("runs_overall", with_views("predictions_a", "predictions_b", """
    SELECT va."group" AS model, va.accuracy AS val_accuracy, va.f1_macro AS val_f1_macro, te.accuracy AS test_accuracy, te.f1_macro AS test_f1_macro,
           0.25::DOUBLE AS test_ece FROM va JOIN te ON va."group" = te."group" """, **_BY_GROUP))
def runs_overall(spark, sf):
    scores = ("val_accuracy", "val_f1_macro", "test_accuracy", "test_f1_macro")
    return rounded(runs.overall(_runs(spark, sf)).select("model", *scores, "test_ece"), *scores)


@query("runs_comparison", with_views("predictions_a", "predictions_b", """
    SELECT va."group" AS model, va.accuracy AS val_accuracy, te.n AS n_train, 'platt' AS calibrate FROM va JOIN te ON va."group" = te."group" """, **_BY_GROUP))
def runs_comparison(spark, sf):
    return runs.comparison(_runs(spark, sf)).select("model", "val_accuracy", "n_train", "calibrate")


@query("runs_top", with_views("predictions_b", """
    SELECT "group" AS model, f1_macro AS test_f1_macro FROM te ORDER BY f1_macro DESC NULLS LAST, "group" LIMIT 5""", te=_BY_GROUP["te"]))
def runs_top(spark, sf):
    return rounded(runs.top_runs(runs.overall(_runs(spark, sf)), 5).select("model", "test_f1_macro"), "test_f1_macro")


@query("runs_per_language", with_views("predictions_b", f"""
    SELECT "group" AS model, 'test' AS split, lang, 'f1_macro' AS metric, f1_macro AS value FROM ({sql_summary('predictions_b', '"group", lang')})"""))
def runs_per_language(spark, sf):
    return rounded(runs.per_language(_runs(spark, sf)), "value")


@query("runs_calibration", with_views("predictions_b", """SELECT "group" AS model, 'test' AS split, 0.25::DOUBLE AS ece, n AS n_samples FROM te""", te=_BY_GROUP["te"]))
def runs_calibration(spark, sf):
    return runs.calibration(_runs(spark, sf)).select("model", "split", "ece", "n_samples")


@query("sink_final", with_views("labelled", """
    SELECT id, text, label, CASE WHEN id % 4 = 0 THEN NULL ELSE "group" END AS "group" FROM labelled"""))
def sink_final(spark, sf):
    path = scratch_path(spark, "final")
    rows = labelled(spark, sf).withColumn("group", F.when(F.col("id") % 4 != 0, F.col("group")))
    sinks.write_final(rows, path)
    return spark.read.parquet(path)


@query("sink_predictions", with_views("predictions_a", """
    SELECT id, text, p.label, pred_label, round(p_POS, 6) AS proba_POS, round(p_NEG, 6) AS proba_NEG, round(p_NEU, 6) AS proba_NEU
    FROM predictions_a p JOIN labelled l USING (id)"""))
def sink_predictions(spark, sf):
    path = scratch_path(spark, "scored")
    sinks.write_predictions(with_text(spark, sf, predictions(spark, sf)), path)
    return rounded(spark.read.parquet(path), *[f"proba_{l}" for l in LABEL_AT])


@query("sink_misclassified", with_views("predictions_a", """
    SELECT regexp_replace(lang || '/' || "group", '[^A-Za-z0-9_-]', '_', 'g') AS category, count(*) AS n FROM predictions_a WHERE label <> pred_label GROUP BY category"""))
def sink_misclassified(spark, sf):
    path = scratch_path(spark, "wrong")
    rows = predictions(spark, sf).withColumn("part", F.concat_ws("/", "lang", "group"))
    sinks.write_misclassified(rows, path, "part")
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("sink_review", with_views("predictions_a", """
    SELECT id, text, p.label AS gold_label, pred_label AS model_label, round(confidence, 6) AS confidence, round(margin, 6) AS margin
    FROM predictions_a p JOIN labelled l USING (id) WHERE p.label <> pred_label"""))
def sink_review(spark, sf):
    path = scratch_path(spark, "review")
    sinks.write_review(with_text(spark, sf, predictions(spark, sf).where("label <> pred_label")), path)
    return spark.read.parquet(path)


@query("sink_metrics", with_views("predictions_a", f"SELECT n, accuracy, f1_macro FROM ({sql_summary('predictions_a')})"))
def sink_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(spark, path, test=M.summary(M.count_table(predictions(spark, sf))), params={"calibrate": "none"})
    doc = spark.read.text(path).select(F.parse_json("value").alias("d"))
    return rounded(doc.select(*[F.variant_get("d", f"$.test.{c}", t).alias(c) for c, t in (
        ("n", "long"), ("accuracy", "double"), ("f1_macro", "double"))]), "accuracy", "f1_macro")


@query("sink_runs", with_views("predictions_a", f"SELECT 'r1' AS run, 'accuracy' AS name, accuracy AS value FROM ({sql_summary('predictions_a')})"))
def sink_runs(spark, sf):
    path = scratch_path(spark, "runs")
    score = M.summary(M.count_table(predictions(spark, sf))).first()
    sinks.record_run(spark, path, "r1", {"seed": 42}, {"accuracy": score["accuracy"]}, {"kind": "check"})
    return rounded(spark.read.parquet(f"{path}/metrics"), "value")


@query("sink_splits", with_views("labelled", """
    SELECT id, text, lang, "group", label, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM labelled"""))
def sink_splits(spark, sf):
    path = scratch_path(spark, "by-split")
    n = F.col("id") % 3
    rows = labelled(spark, sf).withColumn("split", F.when(n == 0, "train").when(n == 1, "val").otherwise("test"))
    sinks.write_splits(rows.drop("seq"), path)
    return spark.read.parquet(path).select("id", "text", "lang", "group", "label", "split")


@query("sink_clean", with_views("raw_rows", """SELECT id, text, upper(trim(label)) AS label, split, lang, "group" FROM raw_rows"""))
def sink_clean(spark, sf):
    path = scratch_path(spark, "clean")
    sinks.write_clean_copy(raw_rows(spark, sf), path)
    return spark.read.parquet(path).select("id", "text", "label", "split", "lang", "group")


@query("sink_queue", with_views("annotations", f"""
    SELECT id, text, annotator_a, label_a, annotator_b, label_b FROM ({_sql_pairs('<>')})""", latest=LATEST))
def sink_queue(spark, sf):
    path = scratch_path(spark, "queue")
    sinks.write_queue(disagreements(annotations(spark, sf)), path)
    return spark.read.parquet(path)


@query("sink_bins", with_views("predictions_a", """
    SELECT CAST(sum(CAST(round(bin_upper * 15) AS BIGINT)) AS BIGINT) AS bins, CAST(sum(count) AS BIGINT) AS n FROM (
      SELECT e AS bin_upper, (SELECT count(*) FROM predictions_a WHERE confidence > e - 1 / 15.0::DOUBLE AND confidence <= e) AS count
      FROM (SELECT unnest(range(1, 16)) / 15.0::DOUBLE AS e))"""))
def sink_bins(spark, sf):
    path = scratch_path(spark, "bins")
    sinks.write_small(reliability_bins(predictions(spark, sf), 15), path)
    bins = spark.read.option("header", True).csv(path)
    upper = F.round(F.col("bin_upper").cast("double") * 15).cast("long")
    return bins.agg(F.sum(upper).alias("bins"), F.sum(F.col("count").cast("long")).alias("n"))


@query("report_tables", with_views("predictions_b", """
    SELECT te."group" AS model, te.f1_macro AS test_f1_macro, (SELECT count(DISTINCT lang) FROM predictions_b p WHERE p."group" = te."group") AS langs
    FROM te""", te=_BY_GROUP["te"]))
def report_tables(spark, sf):
    path, docs = scratch_path(spark, "report"), _runs(spark, sf)
    sinks.write_report(path, overall=runs.overall(docs), per_language=runs.per_language(docs), calibration=runs.calibration(docs))
    tables = runs.read_report(spark, path)
    langs = tables["per_language"].groupBy("model").agg(F.count_distinct("lang").alias("langs"))
    return rounded(tables["overall"].select("model", "test_f1_macro").join(langs, "model"), "test_f1_macro")


def _written(source: str, write):
    """The table of another query, written by its sink and read back, against that query's SQL."""
    @query(f"sink_{source}", ORACLES[source])
    def run(spark, sf):
        path, table = scratch_path(spark, source), QUERIES[source](spark, sf)
        write(table, path)
        return spark.read.schema(table.schema).option("header", True).csv(path)


for _source in ("reliability_bins", "pr_curve", "confusion", "class_report"):
    _written(_source, sinks.write_small if _source != "pr_curve" else lambda table, path: sinks.write_table(table, path, "csv"))


@query("sink_stress_deltas", ORACLES["stress_delta"])
def sink_stress_deltas(spark, sf):
    path, docs = scratch_path(spark, "report"), _runs(spark, sf)
    sinks.write_report(path, overall=runs.overall(docs), per_language=runs.per_language(docs), calibration=runs.calibration(docs),
                       stress_deltas=QUERIES["stress_delta"](spark, sf))
    return runs.read_report(spark, path, ("stress_deltas",))["stress_deltas"]


@query("scan_export_documents", with_views("annotations", "SELECT CAST(id AS VARCHAR) AS id, trim(text) AS text, annotator, label FROM annotations"))
def scan_export_documents(spark, sf):
    """Exports as whole documents: lists of tasks, and objects that hold one beside other fields. A document holds the annotations of a span of rows."""
    rows = annotations(spark, sf)
    choice = F.struct(F.lit("choices").alias("type"), F.struct(F.array("label").alias("choices")).alias("value"))
    task = F.struct(F.col("id").cast("string").alias("task_id"), F.struct("text").alias("data"), F.array(F.struct(
        F.struct(F.col("annotator").alias("username")).alias("completed_by"), F.array(choice).alias("result"))).alias("annotations"))
    documents = rows.groupBy(F.floor(F.col("seq") / 5000).alias("span")).agg(F.collect_list(task).alias("tasks"))
    note = F.struct(F.lit('a "tasks": [ in a note, and }').alias("note"), F.array(F.lit(1)).alias("version"))
    held = F.to_json(F.struct(note.alias("meta"), "tasks", F.array(note).alias("views")))
    path = scratch_path(spark, "export-documents")
    documents.select(F.when(F.col("span") % 2 == 0, F.to_json("tasks")).otherwise(held).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return exports.read_tool_export(spark, path).select("id", "text", "annotator", "label")


@query("model_listing", with_views("predictions_a", "predictions_b", """
    SELECT b.label AS model, CASE WHEN b.label = 'NEU' THEN 'plugin' ELSE 'linear' END AS type, b.label <> 'NEG' AS has_metrics,
           CASE WHEN b.label <> 'NEG' THEN round(avg(CASE WHEN b.pred_label = b.label THEN 1.0::DOUBLE ELSE 0 END), 6) END AS test_accuracy
    FROM predictions_b b GROUP BY b.label"""))
def model_listing(spark, sf):
    """Folders of one model per gold label, with the recall of that label as its test score; one has no metrics, and two hold no model."""
    root = scratch_path(spark, "listing")
    scores = predictions(spark, sf, "b").groupBy("label").agg(F.avg((F.col("label") == F.col("pred_label")).cast("double")).alias("accuracy")).persist()
    for label in LABEL_AT:
        own = scores.where(F.col("label") == label)
        for part in (["config.json"] if label == "NEU" else ["features", "model"]):
            own.select("label").write.text(f"{root}/{label}/{part}")
        if label != "NEG":
            sinks.write_metrics(spark, f"{root}/{label}/metrics.json", test=own.select("accuracy", F.col("accuracy").alias("f1_macro")))
    for empty in ("notes", "features"):
        scores.select("label").write.text(f"{root}/other/{empty}")
    listed = runs.model_listing(spark, root, runs.read_runs(spark, [root]))
    return rounded(listed.select(F.regexp_extract("model", "([^/]+)$", 1).alias("model"), "type", "has_metrics", "test_accuracy"), "test_accuracy")
