"""Fitted models. Their numbers come from an optimiser, so there is no SQL for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from labelweave.catalog.metrics import rounded, sql_summary
from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, documents, labelled, predictions, with_views
from labelweave.operators import explain as E
from labelweave.operators import metrics as M
from labelweave.operators import models
from labelweave.operators.calibration import calibration_summary
from labelweave.operators.models import TrainConfig
from labelweave.plans import evaluation, training

CONFIG = TrainConfig(ngram_min=2, ngram_max=3, min_df=5, max_iter=20, class_weight="balanced")


def _trained(spark, sf, cfg=CONFIG):
    return training.train_and_evaluate(labelled(spark, sf), cfg)


@query("train_predict")
def train_predict(spark, sf):
    return rounded(_trained(spark, sf).scores, "accuracy", "f1_macro")


@query("predict_rows")
def predict_rows(spark, sf):
    scored = _trained(spark, sf).predictions
    return rounded(scored.select("id", "split", "label", "pred_label", "confidence", "margin"), "confidence", "margin")


@query("train_temperature")
def train_temperature(spark, sf):
    from dataclasses import replace
    result = _trained(spark, sf, replace(CONFIG, calibrate="temperature"))
    return rounded(calibration_summary(result.predictions, by=["split"]), "ece", "mce", "brier", "nll")


@query("train_resampled")
def train_resampled(spark, sf):
    from dataclasses import replace
    return rounded(_trained(spark, sf, replace(CONFIG, resample="oversample", class_weight="none")).scores, "accuracy", "f1_macro")


@query("top_features")
def top_features(spark, sf):
    return E.top_features(_trained(spark, sf).classifier.weights(spark), 20)


@query("explain_rows")
def explain_rows(spark, sf):
    result = _trained(spark, sf)
    return E.explain_misclassified(result.predictions, result.classifier, CONFIG.ngram_min, CONFIG.ngram_max).drop("text")


@query("request_records")
def request_records(spark, sf):
    result = _trained(spark, sf)
    out = evaluation.request_records(documents(spark, sf).select("id", "text"), result.classifier, tau=0.6, importance=3, max_chars=4000)
    return rounded(out.select("id", "reason", "pred_label", F.array_join("pred_set", ",").alias("pred_set"), "set_size", "entropy",
                              F.col("importance")[0]["feature"].alias("feature")), "entropy")


@query("lang_routed")
def lang_routed(spark, sf):
    rows = labelled(spark, sf)
    routed = models.fit_language_routed(rows, CONFIG, langs=["de", "en"])
    return rounded(M.summary(M.count_table(routed.score(rows), ["lang"]), ["lang"]), "accuracy", "f1_macro")


@query("stress_eval")
def stress_eval(spark, sf):
    result = _trained(spark, sf)
    test = labelled(spark, sf).withColumnRenamed("lang", "category")
    scores, _ = evaluation.stress_test(test, result.classifier, "mixed_script", 0.3)
    return rounded(scores, "accuracy", "f1_macro")


@query("conformal_flow")
def conformal_flow(spark, sf):
    result = _trained(spark, sf)
    _, coverage, tau = evaluation.conformal_predictions(labelled(spark, sf), result.classifier)
    return rounded(coverage.withColumn("tau", F.lit(tau)), "coverage", "mean_size", "tau")


@query("grid_sweep")
def grid_sweep(spark, sf):
    out = training.sweep(labelled(spark, sf), CONFIG, {"min_df": [5, 10], "norm_punct": [False, True]})
    return rounded(out, "accuracy", "f1_macro")


def _length_model():
    """A stand-in for a user model: class scores from the share of vowels in each text."""
    def predict(texts: np.ndarray) -> np.ndarray:
        share = np.array([sum(t.count(v) for v in "aeiou") / max(1, len(t)) for t in texts])
        return np.stack([share, 0.3 - share, np.full(len(share), 0.1)], axis=1)

    return predict


_VOWELS = "(length(text) - length(translate(text, 'aeiou', ''))) / greatest(1, length(text))::DOUBLE"


@query("plugin_scoring", f"""
    SELECT doc_id AS id, CASE WHEN v >= 0.3 - v AND v > 0.1 THEN 'POS' WHEN 0.3 - v > 0.1 THEN 'NEG' ELSE 'NEU' END AS pred_label,
           round(exp(v) / (exp(v) + exp(0.3 - v) + exp(0.1)), 6) AS proba_pos
    FROM (SELECT doc_id, {_VOWELS} AS v FROM documents)""")
def plugin_scoring(spark, sf):
    out = models.score_with(documents(spark, sf).select("id", "text"), _length_model, LABEL_AT, batch_size=64)
    return out.select("id", "pred_label", F.round(F.element_at("proba", F.lit("POS")), 6).alias("proba_pos"))


@query("error_analysis", with_views("predictions_a", f"""
    SELECT 'all' AS part, n, accuracy, f1_macro FROM ({sql_summary('predictions_a')})
    UNION ALL SELECT lang, n, accuracy, f1_macro FROM ({sql_summary('predictions_a', 'lang')})"""))
def error_analysis(spark, sf):
    out = evaluation.analyse_errors(predictions(spark, sf), slice_column="lang")
    scores = out["scores"].select(F.lit("all").alias("part"), "n", "accuracy", "f1_macro")
    return rounded(scores.unionByName(out["slices"].withColumnRenamed("slice", "part")), "accuracy", "f1_macro")
