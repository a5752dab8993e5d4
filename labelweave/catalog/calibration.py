"""Calibration, precision-recall and prediction sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.catalog.metrics import rounded
from labelweave.catalog.registry import query
from labelweave.catalog.views import LABEL_AT, predictions, with_views
from labelweave.functions import proba as P
from labelweave.operators import calibration as C
from labelweave.operators import compare
from labelweave.operators import conformal as X
from labelweave.operators.models import Calibrator, add_prediction, fit_calibrator


def _sql_edges(n):
    rows = ", ".join(f"({i + 1}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(
        zip(C.bin_edges(n), C.bin_edges(n)[1:])))
    return f"SELECT * FROM (VALUES {rows}) AS e(bin, bin_lower, bin_upper)"


_IN_BIN = "(p.confidence > e.bin_lower AND p.confidence <= e.bin_upper OR (e.bin = 1 AND p.confidence = 0))"
_HIT = "CASE WHEN p.label = p.pred_label THEN 1.0::DOUBLE ELSE 0.0 END"


def _sql_bins(n, idle):
    return f"""SELECT e.bin_lower, e.bin_upper, count(p.id) AS count, coalesce(avg(CASE WHEN p.id IS NOT NULL THEN {_HIT} END), 0) AS accuracy,
                      coalesce(avg(p.confidence), {idle}) AS confidence
               FROM edges e LEFT JOIN predictions_a p ON {_IN_BIN} GROUP BY e.bin_lower, e.bin_upper"""


def _sql_rounded_bins(n, idle):
    return f"""SELECT round(bin_lower, 6) AS bin_lower, round(bin_upper, 6) AS bin_upper, count, round(accuracy, 6) AS accuracy,
                      round(confidence, 6) AS confidence FROM ({_sql_bins(n, idle)})"""


_BIN_COLUMNS = ("bin_lower", "bin_upper", "accuracy", "confidence")


@query("reliability_bins", with_views("predictions_a", _sql_rounded_bins(15, "0.0"), edges=_sql_edges(15)))
def reliability_bins(spark, sf):
    return rounded(C.reliability_bins(predictions(spark, sf), 15), *_BIN_COLUMNS)


@query("reliability_bins_midpoint", with_views("predictions_a", _sql_rounded_bins(10, "(bin_lower + bin_upper) / 2.0"), edges=_sql_edges(10)))
def reliability_bins_midpoint(spark, sf):
    return rounded(C.reliability_bins(predictions(spark, sf), 10, empty="midpoint"), *_BIN_COLUMNS)


@query("ece_mce", with_views("predictions_a", f"""
    SELECT round(sum(count * abs(accuracy - confidence)) / sum(count), 6) AS ece,
           round(max(CASE WHEN count > 0 THEN abs(accuracy - confidence) END), 6) AS mce FROM ({_sql_bins(15, '0.0')})""", edges=_sql_edges(15)))
def ece_mce(spark, sf):
    return rounded(C.calibration_error(C.reliability_bins(predictions(spark, sf), 15)), "ece", "mce")


@query("mce_with_empty_bins", with_views("predictions_a", f"""
    SELECT round(sum(count * abs(accuracy - confidence)) / sum(count), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce
    FROM ({_sql_bins(15, '(bin_lower + bin_upper) / 2.0')})""", edges=_sql_edges(15)))
def mce_with_empty_bins(spark, sf):
    bins = C.reliability_bins(predictions(spark, sf), 15, empty="midpoint")
    return rounded(C.calibration_error(bins, include_empty=True), "ece", "mce")


_SQUARES = " + ".join(f"pow(p_{l} - CASE WHEN label = '{l}' THEN 1 ELSE 0 END, 2)" for l in LABEL_AT)
_P_GOLD = "CASE label " + " ".join(f"WHEN '{l}' THEN p_{l}" for l in LABEL_AT) + " END"
_LOSS = f"-ln(least(greatest({_P_GOLD}, 1e-12), 1.0))"


@query("brier_nll", with_views("predictions_a", f"""
    SELECT lang, count(*) AS n_samples, round(avg({_SQUARES}), 6) AS brier, round(avg({_LOSS}), 6) AS nll FROM predictions_a GROUP BY lang"""))
def brier_nll(spark, sf):
    return rounded(C.proper_scores(predictions(spark, sf), ["lang"]), "brier", "nll")


@query("calibration_summary", with_views("predictions_a", f"""
    SELECT lang, CAST(sum(n) AS BIGINT) AS n_samples, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce,
           round(sum(sq) / sum(n), 6) AS brier, round(sum(ll) / sum(n), 6) AS nll, 3 AS n_classes, 10 AS n_bins
    FROM (SELECT lang, e.bin, count(*) AS n, avg({_HIT}) AS acc, avg(confidence) AS conf, sum({_SQUARES}) AS sq, sum({_LOSS}) AS ll
          FROM predictions_a p JOIN edges e ON {_IN_BIN} GROUP BY lang, e.bin) GROUP BY lang""", edges=_sql_edges(10)))
def calibration_summary(spark, sf):
    return rounded(C.calibration_summary(predictions(spark, sf), 10, ["lang"]), "ece", "mce", "brier", "nll")


_LOGITS = ", ".join(f"ln(p_{l}) - greatest({', '.join(f'ln(p_{m})' for m in LABEL_AT)}) AS z_{l}" for l in LABEL_AT)


def _with_logits(spark, sf):
    return predictions(spark, sf).withColumn("logits", F.transform_values("proba", lambda _, p: F.log(p)))


@query("temperature", with_views("predictions_a", f"""
    SELECT round(t, 6) AS temperature, round(avg(-ln(least(greatest(
        exp(CASE label {' '.join(f"WHEN '{l}' THEN z_{l}" for l in LABEL_AT)} END / t) / ({' + '.join(f'exp(z_{l} / t)' for l in LABEL_AT)}),
        1e-12), 1.0))), 6) AS nll
    FROM (SELECT label, {_LOGITS} FROM predictions_a), (SELECT 0.5::DOUBLE + i * 0.05::DOUBLE AS t FROM range(91) r(i)) GROUP BY t"""))
def temperature(spark, sf):
    return rounded(C.temperature_losses(_with_logits(spark, sf), C.coarse_grid()), "temperature", "nll")


@query("temperature_fit")
def temperature_fit(spark, sf):
    rows = _with_logits(spark, sf)
    best = C.fit_temperature(rows)
    scaled = rows.withColumn("proba", P.softmax("logits", best))
    return rounded(C.proper_scores(scaled).withColumn("temperature", F.lit(best)), "brier", "nll", "temperature")


@query("softmax", with_views("predictions_a", f"""
    SELECT id, {', '.join(f"round(exp(z_{l} / 2.0) / ({' + '.join(f'exp(z_{m} / 2.0)' for m in LABEL_AT)}), 6) AS proba_{l}" for l in LABEL_AT)}
    FROM (SELECT id, {_LOGITS} FROM predictions_a)"""))
def softmax(spark, sf):
    rows = _with_logits(spark, sf).withColumn("proba", P.softmax("logits", 2.0))
    return rounded(rows.select("id", *P.proba_to_columns()), *[f"proba_{l}" for l in LABEL_AT])


@query("confidence_margin", with_views("predictions_a", "SELECT id, pred_label, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM predictions_a"))
def confidence_margin(spark, sf):
    return rounded(add_prediction(predictions(spark, sf).select("id", "proba")).drop("proba"), "confidence", "margin")


@query("entropy", with_views("predictions_a", f"""
    SELECT id, round(-({' + '.join(f'p_{l} * ln(p_{l} + 1e-12)' for l in LABEL_AT)}), 6) AS entropy,
           round(greatest(p_POS, p_NEG, p_NEU), 6) AS max_proba FROM predictions_a"""))
def entropy(spark, sf):
    return predictions(spark, sf).select("id", F.round(P.entropy("proba"), 6).alias("entropy"),
                                         F.round(P.confidence("proba"), 6).alias("max_proba"))


@query("top_classes", with_views("predictions_a", f"""
    SELECT id, CAST(r AS INTEGER) AS place, label, round(prob, 6) AS prob FROM (
      SELECT id, label, prob, row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS r FROM (
        {' UNION ALL '.join(f"SELECT id, '{l}' AS label, p_{l} AS prob FROM predictions_a" for l in LABEL_AT)})) WHERE r <= 2"""))
def top_classes(spark, sf):
    rows = predictions(spark, sf).select("id", F.posexplode(P.top_classes("proba", 2)).alias("p", "e"))
    return rows.select("id", (F.col("p") + 1).alias("place"), "e.label", F.round("e.prob", 6).alias("prob"))


_POINTS = " UNION ALL ".join(
    f"SELECT '{l}' AS class, p_{l} AS score, count(*) AS rows, count(*) FILTER (label = '{l}') AS pos FROM predictions_a GROUP BY p_{l}"
    for l in LABEL_AT)
_CURVE = """SELECT class, score, pos, sum(pos) OVER w AS tp, sum(pos) OVER w / (sum(rows) OVER w)::DOUBLE AS precision,
                   sum(pos) OVER w / (sum(pos) OVER (PARTITION BY class))::DOUBLE AS recall,
                   pos / (sum(pos) OVER (PARTITION BY class))::DOUBLE AS step
            FROM points WINDOW w AS (PARTITION BY class ORDER BY score DESC)"""


@query("pr_curve", with_views("predictions_a", """
    SELECT class, round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve
    UNION ALL SELECT DISTINCT class, NULL, 1.0, 0.0 FROM curve""", points=_POINTS, curve=_CURVE))
def pr_curve(spark, sf):
    return rounded(C.pr_curve(C.pr_points(predictions(spark, sf))), "threshold", "precision", "recall")


@query("average_precision", with_views("predictions_a", "SELECT class, round(sum(step * precision), 6) AS average_precision FROM curve GROUP BY class",
                                       points=_POINTS, curve=_CURVE))
def average_precision(spark, sf):
    return rounded(C.average_precision(C.pr_points(predictions(spark, sf))), "average_precision")


@query("best_threshold", with_views("predictions_a", """
    SELECT class, round(arg_max(score, (f1, -score)), 6) AS threshold, round(max(f1), 6) AS f1
    FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM curve)
    GROUP BY class""", points=_POINTS, curve=_CURVE))
def best_threshold(spark, sf):
    return rounded(C.best_thresholds(C.pr_points(predictions(spark, sf))), "threshold", "f1")


_TAU = f"""SELECT list_sort(list(1.0 - {_P_GOLD}))[CAST(ceil(least(1.0, greatest(0.0, ceil((count(*) + 1) * 0.9::DOUBLE) / count(*))) * (count(*) - 1)) AS BIGINT) + 1] AS tau,
                  count(*) AS n FROM predictions_a WHERE id % 2 = 0"""


@query("conformal_tau", with_views("predictions_a", "SELECT round(tau, 6) AS tau, n FROM calibrated", calibrated=_TAU))
def conformal_tau(spark, sf):
    return rounded(X.tau_table(predictions(spark, sf).where("id % 2 = 0"), 0.9), "tau")


_SETS = f"""SELECT id, lang, label, list_filter([{', '.join(f"CASE WHEN 1.0 - p_{l} <= tau THEN '{l}' END" for l in LABEL_AT)}], lambda x: x IS NOT NULL) AS s
            FROM predictions_a, calibrated"""


def _with_sets(spark, sf):
    rows = predictions(spark, sf)
    tau = X.fit_tau(rows.where("id % 2 = 0"), coverage=0.9)
    return X.prediction_sets(rows, tau)


@query("conformal_sets", with_views("predictions_a", "SELECT id, array_to_string(s, ',') AS pred_set, CAST(len(s) AS INTEGER) AS set_size FROM sets",
                                    calibrated=_TAU, sets=_SETS))
def conformal_sets(spark, sf):
    return _with_sets(spark, sf).select("id", F.array_join("pred_set", ",").alias("pred_set"), "set_size")


@query("coverage", with_views("predictions_a", """
    SELECT lang, count(*) AS n, round(avg(CASE WHEN list_contains(s, label) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
           round(avg(len(s)), 6) AS mean_size FROM sets GROUP BY lang""", calibrated=_TAU, sets=_SETS))
def coverage(spark, sf):
    return rounded(X.coverage(_with_sets(spark, sf), by=["lang"]), "coverage", "mean_size")


# A sweep over parameters is one fan-out and one aggregate.
@query("parameter_sweep", with_views("predictions_a", f"""
    SELECT tau, min_confidence, count(*) AS n, round(avg({_HIT}), 6) AS accuracy,
           round(avg({' + '.join(f'CASE WHEN 1.0 - p_{l} <= tau THEN 1 ELSE 0 END' for l in LABEL_AT)}), 6) AS mean_size
    FROM predictions_a p, (SELECT unnest([0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS tau), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS min_confidence)
    WHERE confidence >= min_confidence GROUP BY tau, min_confidence"""))
def parameter_sweep(spark, sf):
    rows = compare.fan_out(predictions(spark, sf), {"tau": [0.4, 0.6, 0.8], "min_confidence": [0.0, 0.5]})
    sized = X.prediction_sets(rows.where("confidence >= min_confidence"), F.col("tau"))
    hit = (F.col("label") == F.col("pred_label")).cast("double")
    return sized.groupBy("tau", "min_confidence").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg("set_size"), 6).alias("mean_size"))


def _recalibrated(spark, sf, method):
    rows = _with_logits(spark, sf)
    fitted: Calibrator = fit_calibrator(rows.where("id % 2 = 0"), method, sorted(LABEL_AT))
    after = add_prediction(fitted.apply(rows.where("id % 2 = 1"), sorted(LABEL_AT)))
    return rounded(C.calibration_summary(after, 15), "ece", "mce", "brier", "nll")


@query("platt_calibration")
def platt_calibration(spark, sf):
    return _recalibrated(spark, sf, "platt")


@query("isotonic_calibration")
def isotonic_calibration(spark, sf):
    return _recalibrated(spark, sf, "isotonic")
