"""Review queues and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.metrics import rounded, sql_summary
from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, draw, labelled, predictions, sql_draw, sql_hash, with_views
from labelweave.functions import labels as L
from labelweave.functions.proba import proba_to_columns
from labelweave.operators import compare as C
from labelweave.operators import metrics as M
from labelweave.operators import review as R
from labelweave.operators.agreement import queue_new

_WRONG = "SELECT * FROM predictions_a WHERE label <> pred_label"


@query("misclassified", with_views("predictions_a", """
    SELECT id, label, pred_label, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM wrong""", wrong=_WRONG))
def misclassified(spark, sf):
    rows = R.misclassified(predictions(spark, sf))
    return rounded(rows.select("id", "label", "pred_label", "confidence", "margin"), "confidence", "margin")


def _queue(name, strategy, order):
    @query(name, with_views("predictions_a", f"""
        SELECT id, label, pred_label, round(confidence, 6) AS confidence, round(margin, 6) AS margin
        FROM wrong ORDER BY {order} LIMIT 50""", wrong=_WRONG))
    def run(spark, sf):
        wrong = predictions(spark, sf).where("label <> pred_label")
        queue = R.review_queue(wrong, strategy, limit=50)
        return rounded(queue.select("id", "label", "pred_label", "confidence", "margin"), "confidence", "margin")


_queue("review_uncertain", "uncertain", "margin, confidence DESC, id")
_queue("review_confident_wrong", "confident_wrong", "confidence DESC, margin DESC, id")
_queue("review_random", "random", f"{sql_hash(42, 'id')}, id")


@query("review_new", with_views("predictions_a", f"""
    SELECT id, '- Item ID: ' || CAST(id AS VARCHAR) || chr(10) || '- Text (de-identified): ' || doc.text || chr(10) ||
           '- Label A: ' || label || chr(10) || '- Label B: ' || pred_label || ' (model)' || chr(10) ||
           '- Final Label: <POS/NEG/NEU>' || chr(10) || '- Action Items: <add example/update guidelines/augment data>' AS note
    FROM wrong JOIN documents doc ON doc.doc_id = wrong.id WHERE {sql_draw('logged', 'id')} % 4 <> 0""", wrong=_WRONG))
def review_new(spark, sf):
    wrong = predictions(spark, sf).where("label <> pred_label")
    logged = labelled(spark, sf, text=False).where(draw("logged", "id") % 4 == 0)
    texts = labelled(spark, sf).select("id", "text")
    new = queue_new(wrong, logged).join(texts, "id")
    return new.select("id", L.review_note(F.col("id").cast("string"), "text", "label", "pred_label").alias("note"))


@query("error_rows", with_views("predictions_a", f"""
    SELECT CAST(id AS VARCHAR) AS id, label, pred_label, round(confidence, 6) AS confidence, round(CASE WHEN id % 2 = 0 THEN margin ELSE 0.01::DOUBLE END, 6) AS margin FROM wrong""",
                                wrong=_WRONG))
def error_rows(spark, sf):
    wrong = predictions(spark, sf).where("label <> pred_label")
    typed = wrong.select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("id"), F.lit("").alias("text"), F.lower("label").alias("label"),
        "pred_label", *[c.cast("string").alias(f"proba_{l}") for c, l in zip(proba_to_columns(), LABEL_AT)],
        F.when(F.col("id") % 2 == 0, "n/a").otherwise(F.col("confidence").cast("string")).alias("confidence"),
        F.when(F.col("id") % 2 == 0, "").otherwise("0.01").alias("margin"))
    return rounded(R.fill_uncertainty(typed).select("id", "label", "pred_label", "confidence", "margin"), "confidence", "margin")


@query("align_predictions", with_views("predictions_a", "predictions_b", """
    SELECT a.id, a.label, a.pred_label AS pred_a, b.pred_label AS pred_b FROM predictions_a a JOIN predictions_b b ON a.id = b.id WHERE b.id % 3 <> 0"""))
def align_predictions(spark, sf):
    return C.align(predictions(spark, sf, "a"), predictions(spark, sf, "b").where("id % 3 <> 0"))


@query("joint_counts", with_views("predictions_a", "predictions_b", """
    SELECT a.label, a.pred_label AS pred_a, b.pred_label AS pred_b, count(*) AS n
    FROM predictions_a a JOIN predictions_b b ON a.id = b.id GROUP BY ALL"""))
def joint_counts(spark, sf):
    return C.joint_counts(predictions(spark, sf, "a"), predictions(spark, sf, "b"))


@query("model_compare", with_views("predictions_a", "predictions_b", """
    SELECT coalesce(a.id, b.id) AS id, a.pred_label AS pred_a, b.pred_label AS pred_b, round(a.confidence, 6) AS confidence_a,
           round(b.confidence, 6) AS confidence_b, a.pred_label = b.pred_label AS same
    FROM (SELECT * FROM predictions_a WHERE id % 5 <> 0) a FULL OUTER JOIN (SELECT * FROM predictions_b WHERE id % 7 <> 0) b ON a.id = b.id"""))
def model_compare(spark, sf):
    out = C.side_by_side(predictions(spark, sf, "a").where("id % 5 <> 0"), predictions(spark, sf, "b").where("id % 7 <> 0"))
    return rounded(out, "confidence_a", "confidence_b")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return rounded(C.paired_bootstrap(predictions(spark, sf, "a"), predictions(spark, sf, "b")), "point", "low", "high")


@query("bootstrap_points", with_views("predictions_a", "predictions_b", """
    SELECT 'acc_a' AS score, accuracy AS point, n FROM sum_a UNION ALL SELECT 'acc_b', accuracy, n FROM sum_b
    UNION ALL SELECT 'f1_a', f1_macro, n FROM sum_a UNION ALL SELECT 'f1_b', f1_macro, n FROM sum_b""",
                                      sum_a=sql_summary("predictions_a"), sum_b=sql_summary("predictions_b")))
def bootstrap_points(spark, sf):
    pair = predictions(spark, sf, "a"), predictions(spark, sf, "b")
    out = C.paired_bootstrap(*pair, n_bootstrap=200).where("score NOT LIKE '%delta'")
    return rounded(out.select("score", "point", "n"), "point")


@query("stress_delta", with_views("predictions_a", "predictions_b", f"""
    SELECT a.lang AS model, round(a.accuracy - b.accuracy, 5) AS delta_accuracy, round(a.f1_macro - b.f1_macro, 5) AS delta_f1_macro
    FROM ({sql_summary('predictions_a', 'lang')}) a JOIN ({sql_summary('predictions_b', 'lang')}) b ON a.lang = b.lang"""))
def stress_delta(spark, sf):
    clean, stressed = [rounded(M.summary(M.count_table(predictions(spark, sf, m), ["lang"]), ["lang"]), "accuracy", "f1_macro")
                       .withColumnRenamed("lang", "model") for m in "ab"]
    out = C.robustness_deltas(clean, stressed)
    return out.withColumns({c: F.round(c, 5) for c in ("delta_accuracy", "delta_f1_macro")})


@query("stress_unmatched", with_views("predictions_a", "SELECT DISTINCT \"group\" AS model FROM predictions_a WHERE \"group\" NOT IN (SELECT \"group\" FROM predictions_a WHERE \"group\" LIKE 'src1%')"))
def stress_unmatched(spark, sf):
    models = predictions(spark, sf).select(F.col("group").alias("model")).distinct()
    return C.unmatched_models(models.where("model LIKE 'src1%'"), models)
