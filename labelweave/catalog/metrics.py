"""Classification metrics from the count table."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, draw, labelled, predictions, sql_draw, with_views
from labelweave.operators import metrics as M


def sql_marginals(source, by=""):
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}label, CAST(sum(g) AS BIGINT) AS gold_n, CAST(sum(p) AS BIGINT) AS pred_n, CAST(sum(h) AS BIGINT) AS hits
               FROM (SELECT {lead}label, 1 AS g, 0 AS p, CASE WHEN label = pred_label THEN 1 ELSE 0 END AS h FROM {source}
                     UNION ALL SELECT {lead}pred_label, 0, 1, 0 FROM {source}) GROUP BY {lead}label"""


def sql_summary(source, by=""):
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}CAST(sum(gold_n) AS BIGINT) AS n, round(sum(hits) / sum(gold_n)::DOUBLE, 6) AS accuracy,
                      round(avg(2 * hits / (gold_n + pred_n)::DOUBLE), 6) AS f1_macro
               FROM ({sql_marginals(source, by)}) {group}"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scores(df):
    return rounded(df, "accuracy", "f1_macro")


@query("metrics_overall", with_views("predictions_a", sql_summary("predictions_a")))
def metrics_overall(spark, sf):
    return _scores(M.summary(M.count_table(predictions(spark, sf))))


@query("metrics_by_lang", with_views("predictions_a", sql_summary("predictions_a", "lang")))
def metrics_by_lang(spark, sf):
    return _scores(M.summary(M.count_table(predictions(spark, sf), ["lang"]), ["lang"]))


@query("metrics_language_keys", with_views("predictions_a", f"""
    SELECT 'accuracy__' || lang AS metric, accuracy AS value FROM ({sql_summary('predictions_a', 'lang')})
    UNION ALL SELECT 'f1_macro__' || lang, f1_macro FROM ({sql_summary('predictions_a', 'lang')})"""))
def metrics_language_keys(spark, sf):
    return rounded(M.per_language(predictions(spark, sf)), "value")


_COUNTS = "SELECT label AS gold, pred_label AS pred, count(*) AS n FROM predictions_a GROUP BY label, pred_label"


@query("confusion", with_views("predictions_a", """
    SELECT g.gold, count(*) FILTER (pred_label = 'POS') AS pred_POS, count(*) FILTER (pred_label = 'NEG') AS pred_NEG,
           count(*) FILTER (pred_label = 'NEU') AS pred_NEU
    FROM (SELECT unnest(['POS', 'NEG', 'NEU']) AS gold) g LEFT JOIN predictions_a p ON p.label = g.gold GROUP BY g.gold"""))
def confusion(spark, sf):
    return M.confusion(M.count_table(predictions(spark, sf)))


@query("confusion_by_lang", with_views("predictions_a", """
    SELECT lang, label AS gold, count(*) FILTER (pred_label = 'POS') AS pred_POS, count(*) FILTER (pred_label = 'NEG') AS pred_NEG,
           count(*) FILTER (pred_label = 'NEU') AS pred_NEU FROM predictions_a GROUP BY lang, label"""))
def confusion_by_lang(spark, sf):
    return M.confusion(M.count_table(predictions(spark, sf), ["lang"]), by=["lang"])


_REPORT = """SELECT label, coalesce(hits / nullif(pred_n, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(gold_n, 0)::DOUBLE, 0) AS recall,
                    2 * hits / (gold_n + pred_n)::DOUBLE AS f1, gold_n AS support FROM ({})"""


@query("class_report", with_views("predictions_a", """
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
      SELECT * FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support) FROM per)""", per=_REPORT.format(sql_marginals("predictions_a"))))
def class_report(spark, sf):
    return rounded(M.report(M.count_table(predictions(spark, sf))), "precision", "recall", "f1")


_SLICED = f"""SELECT *, CASE WHEN {sql_draw('slice', 'id')} % 6 = 0 THEN '__EMPTY__' ELSE "group" END AS slice FROM predictions_a"""


@query("per_slice", with_views("predictions_a", sql_summary("sliced", "slice"), sliced=_SLICED))
def per_slice(spark, sf):
    rows = predictions(spark, sf).withColumn("part", F.when(draw("slice", "id") % 6 == 0, " ").otherwise(F.col("group")))
    return _scores(M.per_slice(rows, "part"))


@query("overall_and_category", with_views("predictions_a", f"""
    SELECT 'overall' AS scope, NULL AS category, n, accuracy, f1_macro FROM ({sql_summary('predictions_a')})
    UNION ALL SELECT 'category', "group", n, accuracy, f1_macro FROM ({sql_summary('predictions_a', '"group"')})"""))
def overall_and_category(spark, sf):
    return _scores(M.overall_and_per_category(predictions(spark, sf), "group"))


@query("evaluate_if_labelled", with_views("predictions_a", sql_summary("(SELECT * FROM predictions_a WHERE id % 3 <> 0)")))
def evaluate_if_labelled(spark, sf):
    rows = predictions(spark, sf).withColumn("label", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("label")))
    return _scores(M.summary(M.count_table(M.only_labelled(rows))))


@query("label_distribution", with_views("labelled", """
    SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT label, 1 AS n FROM labelled
      UNION ALL SELECT unnest(['POS', 'NEG', 'NEU', 'MIXED']), 0) GROUP BY label"""))
def label_distribution(spark, sf):
    return M.distribution(labelled(spark, sf, text=False), "label", [*LABEL_AT, "MIXED"])


@query("label_lang_distribution", with_views("labelled", "SELECT label, lower(coalesce(lang, 'unk')) AS lang, count(*) AS n FROM labelled GROUP BY ALL"))
def label_lang_distribution(spark, sf):
    return M.label_language_distribution(labelled(spark, sf, text=False))


@query("label_universe", with_views("predictions_a", "SELECT label FROM predictions_a UNION SELECT pred_label FROM predictions_a"))
def label_universe(spark, sf):
    return M.label_universe(predictions(spark, sf))


@query("class_weights", with_views("labelled", """
    SELECT label, count(*) AS n, round((SELECT count(*) FROM labelled) / (3.0::DOUBLE * count(*)), 6) AS weight FROM labelled GROUP BY label"""))
def class_weights(spark, sf):
    return rounded(M.class_weights(labelled(spark, sf, text=False)), "weight")


@query("class_weight_map", with_views("labelled", """
    SELECT lang, round(sum(CASE label WHEN 'POS' THEN 0.5::DOUBLE WHEN 'NEG' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS mass
    FROM labelled GROUP BY lang"""))
def class_weight_map(spark, sf):
    weight = M.weight_of("label", {"pos": 0.5, "NEG": 2.0})
    return labelled(spark, sf, text=False).groupBy("lang").agg(F.round(F.sum(weight), 6).alias("mass"))
