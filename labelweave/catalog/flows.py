"""Whole flows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.agreement import DECISIONS, LATEST, TOTALS, _MAJORITY, _logged, _pair_counts, _sql_kappa, _sql_pairs
from labelweave.catalog.metrics import rounded
from labelweave.catalog.quality import LANGS, ROW_ISSUES
from labelweave.catalog.registry import query
from labelweave.catalog.splits import sql_group_split
from labelweave.catalog.training import CONFIG, _VOWELS, _length_model
from labelweave.catalog.views import LABEL_AT, annotations, documents, labelled, predictions, raw_rows, sql_hash, with_text, with_views
from labelweave.operators import models
from labelweave.plans import curation, evaluation, reporting
from labelweave.session import scratch_path
from labelweave.streaming import flows as S

_FINAL = f"""SELECT t.id, coalesce(d.final_label, CASE WHEN best = total THEN top END, {_MAJORITY}) AS label
             FROM totals t LEFT JOIN decisions d ON d.id = t.id
             WHERE coalesce(d.final_label, CASE WHEN best = total THEN top END, {_MAJORITY}) IS NOT NULL"""
_SPLIT = f"""SELECT id, label, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val'
                              ELSE 'test' END AS split
             FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'id')}, CAST(id AS VARCHAR)) AS r,
                          count(*) OVER (PARTITION BY label) AS n FROM final)"""


@query("combine_flow", with_views("annotations", _SPLIT, totals=TOTALS, decisions=DECISIONS, final=_FINAL))
def combine_flow(spark, sf):
    final, _ = curation.combine(annotations(spark, sf), "majority", decisions=_logged(spark, sf))
    return final.select("id", "label", "split")


@query("publish_flow", with_views("annotations", """
    SELECT label, count(*) AS n FROM final GROUP BY label""", totals=TOTALS, decisions=DECISIONS, final=_FINAL))
def publish_flow(spark, sf):
    final, _ = curation.combine(annotations(spark, sf), "majority", decisions=_logged(spark, sf))
    return curation.publish(final, scratch_path(spark, "dataset"))


@query("split_flow", with_views("raw_rows", sql_group_split('k.id, k."group"'), keyed="""
    SELECT id, nullif(trim("group"), '') AS "group", coalesce(nullif(trim("group"), ''), '__nogroup_' || id) AS g
    FROM raw_rows WHERE trim(id) <> '' AND trim(label) <> ''"""))
def split_flow(spark, sf):
    return curation.split_dataset(raw_rows(spark, sf), by_group=True).select("id", "group", "split")


@query("ingest_flow")
def ingest_flow(spark, sf):
    final, issues = curation.ingest(raw_rows(spark, sf), group="group", lang="lang", langs=LANGS)
    return final.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("queue_flow", with_views("annotations", f"""
    SELECT id, annotator_a, annotator_b, label_a, label_b FROM ({_sql_pairs('<>')}) WHERE id NOT IN (SELECT id FROM decisions)
    ORDER BY id, annotator_a, annotator_b LIMIT 100""", latest=LATEST, decisions=DECISIONS))
def queue_flow(spark, sf):
    return curation.queue(annotations(spark, sf), _logged(spark, sf), limit=100).select(
        "id", "annotator_a", "annotator_b", "label_a", "label_b")


_KAPPA = {by: _sql_kappa(_pair_counts(by), tuple(by.split(", ")), "'NaN'::DOUBLE") for by in ("annotator_a, annotator_b", "lang, annotator_a, annotator_b")}


@query("agreement_flow", with_views("annotations", f"""
    SELECT 'all' AS lang, * FROM ({_KAPPA['annotator_a, annotator_b']}) UNION ALL SELECT * FROM ({_KAPPA['lang, annotator_a, annotator_b']})""", latest=LATEST))
def agreement_flow(spark, sf):
    tables = curation.agreement(annotations(spark, sf), "lang")
    pairs = tables["pairs"].withColumn("lang", F.lit("all")).unionByName(tables["pairs_by_lang"])
    return rounded(pairs, "kappa")


@query("error_loop", with_views("predictions_a", """
    SELECT id, text, gold AS gold_label, pred_label AS model_label, round(confidence, 6) AS confidence, round(margin, 6) AS margin,
           '- Item ID: ' || CAST(id AS VARCHAR) || chr(10) || '- Text (de-identified): ' || text || chr(10) || '- Label A: ' || gold || chr(10) ||
           '- Label B: ' || pred_label || ' (model)' || chr(10) || '- Final Label: <POS/NEG/NEU>' || chr(10) ||
           '- Action Items: <add example/update guidelines/augment data>' AS note
    FROM (SELECT id, text, p.label AS gold, pred_label, confidence, margin FROM predictions_a p JOIN labelled l USING (id)
          WHERE p.label <> pred_label AND id NOT IN (SELECT id FROM decisions) ORDER BY margin, confidence DESC, id LIMIT 20)""", decisions=DECISIONS))
def error_loop(spark, sf):
    return evaluation.error_loop(with_text(spark, sf, predictions(spark, sf)), _logged(spark, sf), limit=20)


@query("report_flow")
def report_flow(spark, sf):
    from labelweave.catalog.files import _runs
    tables = reporting.run_report(_runs(spark, sf), {"a_b": (predictions(spark, sf, "a"), predictions(spark, sf, "b"))})
    return rounded(tables["intervals"], "point", "low", "high")


@query("whole_chain")
def whole_chain(spark, sf):
    from dataclasses import replace
    rows = labelled(spark, sf).select("id", "text", "label", "seq")
    tables = reporting.whole_chain(rows, scratch_path(spark, "chain"), replace(CONFIG, max_iter=10), "run1", num_merges=2)
    scores = tables["scores"].select(F.col("split").alias("part"), "n", "accuracy", "f1_macro")
    stress = tables["stress_mixed_script"].where("scope = 'overall'").select(F.lit("stress").alias("part"), "n", "accuracy", "f1_macro")
    return rounded(scores.unionByName(stress), "accuracy", "f1_macro")


def _as_stream(spark, df, name, batches=4, by="seq"):
    """The table as files in ranges of ``by``, read in several micro-batches. The session's shuffle partitions bound a file,
    also where ``by`` has few values."""
    path = scratch_path(spark, name)
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    df.repartitionByRange(batches * each, by, "seq").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _document_stream(spark, sf):
    # The table may be one file, or a folder of files; a stream takes either by a pattern only.
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    files = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    return files.select(F.col("doc_id").alias("id"), "text", "lang")


@query("stream_score", f"""
    SELECT doc_id AS id, CASE WHEN length(text) > 4000 THEN 'too_long'
             WHEN v >= 0.3 - v AND v > 0.1 THEN 'POS' WHEN 0.3 - v > 0.1 THEN 'NEG' ELSE 'NEU' END AS outcome
    FROM (SELECT doc_id, text, {_VOWELS} AS v FROM documents)""")
def stream_score(spark, sf):
    out = scratch_path(spark, "stream-score")
    S.score_stream(_document_stream(spark, sf), lambda rows: models.score_with(rows, _length_model, LABEL_AT), out).awaitTermination()
    scored, rejected = spark.read.parquet(f"{out}/scored"), spark.read.parquet(f"{out}/rejected")
    return scored.select("id", F.col("pred_label").alias("outcome")).unionByName(rejected.select("id", F.col("reason").alias("outcome")))


@query("stream_validate", with_views("raw_rows", ROW_ISSUES))
def stream_validate(spark, sf):
    out = scratch_path(spark, "stream-check")
    S.check_stream(_as_stream(spark, raw_rows(spark, sf), "raw"), out, lang="lang", split="split", langs=LANGS).awaitTermination()
    return spark.read.parquet(f"{out}/quarantine").select("seq", "id", F.inline("issues"))


def _intake(spark, sf, by="seq"):
    """By `label` an item's annotations come in several batches, so labels change after their pairs were queued."""
    out = scratch_path(spark, "stream-intake")
    S.annotation_stream(_as_stream(spark, annotations(spark, sf), "annotations", by=by), out).awaitTermination()
    return out


@query("annotation_intake", with_views("annotations", f"SELECT id, annotator, label FROM ({LATEST})"))
def annotation_intake(spark, sf):
    return S.current_labels(spark, _intake(spark, sf)).select("id", "annotator", "label")


@query("annotation_intake_queue", with_views("annotations", f"SELECT id, annotator_a, label_a, annotator_b, label_b FROM ({_sql_pairs('<>')})", latest=LATEST))
def annotation_intake_queue(spark, sf):
    return S.current_queue(spark, _intake(spark, sf, "label")).select("id", "annotator_a", "label_a", "annotator_b", "label_b")
