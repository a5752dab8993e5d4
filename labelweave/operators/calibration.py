"""Are the probabilities right? Reliability bins, scores, precision-recall and temperature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions import proba as P
from labelweave.operators.ordering import running_totals
from labelweave.schema import LABELS

# Temperature grids as (first, last, points), the floor and the half-width of the second one.
COARSE_GRID = (0.5, 5.0, 91)
FINE_POINTS, FINE_HALF_WIDTH, FINE_FLOOR = 101, 0.5, 0.1
MIN_TEMPERATURE = 1e-6


def bin_edges(n_bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]


def bin_number(conf: Column, n_bins: int) -> Column:
    """1-based bin of a confidence; bins are (lo, hi], the first one includes 0.

    ceil(conf * n) can be one off at an edge, so it is compared with the edges themselves.
    """
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    guess = F.least(F.lit(n_bins), F.greatest(F.lit(1), F.ceil(conf * n_bins).cast("int")))
    lower, upper = F.element_at(edges, guess), F.element_at(edges, guess + 1)
    return F.when((conf <= lower) & (guess > 1), guess - 1).when(conf > upper, guess + 1).otherwise(guess)


def reliability_bins(df: DataFrame, n_bins: int = 15, empty: str = "zero", by: Sequence[str] = (),
                     gold: str = "label", pred: str = "pred_label", conf: str = "confidence") -> DataFrame:
    """(bin_lower, bin_upper, count, accuracy, confidence) for every bin.

    An empty bin reports confidence 0 (``zero``) or its mid-point (``midpoint``); in the latter form an input
    without rows has no bins.
    """
    if empty not in ("zero", "midpoint"):
        raise ValueError(f"unknown treatment of empty bins {empty!r}")
    hits = df.select(*by, bin_number(F.col(conf), n_bins).alias("bin"), F.col(conf).alias("_conf"),
                     (F.col(gold) == F.col(pred)).cast("double").alias("_hit"))
    filled = hits.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.avg("_hit").alias("accuracy"),
                                          F.avg("_conf").alias("confidence"))
    edges = bin_edges(n_bins)
    frame = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(edges[i]).alias("bin_lower"),
                               F.lit(edges[i + 1]).alias("bin_upper")) for i in range(n_bins)])
    if by:
        slices = filled.select(*by).distinct()
    elif empty == "zero":
        slices = df.sparkSession.range(1).select()
    else:
        slices = filled.select(F.lit(1).alias("_any")).distinct().select()
    idle = F.lit(0.0) if empty == "zero" else (F.col("bin_lower") + F.col("bin_upper")) / 2.0
    return (slices.select(*by, F.inline(frame)).join(filled, [*by, "bin"], "left")
            .select(*by, "bin_lower", "bin_upper", F.coalesce("count", F.lit(0)).alias("count"),
                    F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                    F.coalesce("confidence", idle).alias("confidence")))


def calibration_error(bins: DataFrame, by: Sequence[str] = (), include_empty: bool = False) -> DataFrame:
    """Expected and maximum gap between accuracy and confidence; 0 without rows."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    worst = F.max(gap if include_empty else F.when(F.col("count") > 0, gap))
    return bins.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("count") * gap) / F.nullif(F.sum("count"), F.lit(0)), F.lit(0.0)).alias("ece"),
        F.coalesce(worst, F.lit(0.0)).alias("mce"))


def proper_scores(df: DataFrame, by: Sequence[str] = (), gold: str = "label", proba: str = "proba") -> DataFrame:
    """Brier score and negative log-likelihood."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.avg(P.squared_error(proba, gold)).alias("brier"),
                               F.avg(P.log_loss(proba, gold)).alias("nll"))


def calibration_summary(df: DataFrame, n_bins: int = 15, by: Sequence[str] = (), gold: str = "label",
                        proba: str = "proba", labels: Sequence[str] = LABELS) -> DataFrame:
    """ECE, MCE, Brier and NLL in one row per slice.

    One pass: rows fold into (slice, bin) cells that also carry the score sums.
    """
    rows = df.select(*by, F.col(gold).alias("_gold"), F.col(proba).alias("_proba"),
                     P.confidence(proba).alias("_conf"), (P.argmax_label(proba) == F.col(gold)).alias("_hit"))
    cells = rows.groupBy(*by, bin_number(F.col("_conf"), n_bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_hit").cast("double")).alias("acc"), F.avg("_conf").alias("conf"),
        F.sum(P.squared_error("_proba", "_gold")).alias("sq"), F.sum(P.log_loss("_proba", "_gold")).alias("ll"))
    gap = F.abs(F.col("acc") - F.col("conf"))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("ll") / F.sum("n")).alias("nll"),
        F.lit(len(labels)).alias("n_classes"), F.lit(n_bins).alias("n_bins"))


def _score_points(df: DataFrame, labels: Sequence[str], gold: str, proba: str) -> DataFrame:
    """Rows and positives per (class, distinct score): copies of a score fold before anything is ordered."""
    one_vs_rest = F.array(*[F.struct(F.lit(l).alias("class"), F.element_at(F.col(proba), F.lit(l)).alias("score"),
                                     (F.col(gold) == l).cast("long").alias("positive")) for l in labels])
    return (df.select(F.inline(one_vs_rest)).groupBy("class", "score")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("positive").alias("positives")))


def pr_points(df: DataFrame, labels: Sequence[str] = LABELS, gold: str = "label", proba: str = "proba",
              bins: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score of every class."""
    points = _score_points(df, labels, gold, proba).persist()
    running = running_totals(points, "score", ["rows", "positives"], by=["class"], descending=True, bins=bins)
    totals = points.groupBy("class").agg(F.sum("positives").alias("_all"))
    recall = F.when(F.col("_all") > 0, F.col("cum_positives") / F.col("_all")).otherwise(1.0)
    return running.join(F.broadcast(totals), "class").select(
        "class", F.col("score").alias("threshold"), (F.col("cum_positives") / F.col("cum_rows")).alias("precision"),
        recall.alias("recall"),
        F.when(F.col("_all") > 0, F.col("positives") / F.col("_all")).otherwise(0.0).alias("recall_step"))


def pr_curve(points: DataFrame) -> DataFrame:
    """The points, closed by (precision 1, recall 0) without a threshold."""
    end = points.select("class").distinct().select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.select("class", "threshold", "precision", "recall").unionByName(end)


def average_precision(points: DataFrame) -> DataFrame:
    return points.groupBy("class").agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def best_thresholds(points: DataFrame) -> DataFrame:
    """Threshold of the highest F1 per class, the lowest one on a tie."""
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))
    return points.groupBy("class").agg(best.alias("b")).select(
        "class", (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def _nll_at(temperature: Column, labels: Sequence[str], gold: str) -> Column:
    """-ln p(gold) at a temperature, from max-shifted logit columns z0..zk."""
    total = sum(F.exp(F.col(f"_z{i}") / temperature) for i in range(len(labels)))
    p = F.exp(F.col("_zy") / temperature) / total
    return -F.log(F.least(F.greatest(p, F.lit(P.EPSILON)), F.lit(1.0)))


def temperature_losses(df: DataFrame, grid: Sequence[float], labels: Sequence[str] = LABELS, gold: str = "label",
                       logits: str = "logits") -> DataFrame:
    """Mean negative log-likelihood per temperature of the grid.

    Rows fan out over the grid inside the task and fold straight into one partial sum per temperature.
    """
    z = [F.element_at(F.col(logits), F.lit(l)) for l in labels]
    top = F.greatest(*z)
    rows = df.select(*[(c - top).alias(f"_z{i}") for i, c in enumerate(z)],
                     (F.element_at(F.col(logits), F.col(gold)) - top).alias("_zy"))
    fanned = rows.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return fanned.groupBy("temperature").agg(F.avg(_nll_at(F.col("temperature"), labels, gold)).alias("nll"))


def coarse_grid() -> list[float]:
    first, last, points = COARSE_GRID
    return [float(t) for t in np.linspace(first, last, points)]


def fine_grid(centre: float) -> list[float]:
    lo = max(FINE_FLOOR, centre - FINE_HALF_WIDTH)
    return [float(t) for t in np.linspace(lo, centre + FINE_HALF_WIDTH, FINE_POINTS)]


def fit_temperature(df: DataFrame, labels: Sequence[str] = LABELS, gold: str = "label",
                    logits: str = "logits") -> float:
    """Temperature of least loss: coarse grid, then a fine one around its best; the first wins a tie."""
    strays = df.where(~F.col(gold).isin(list(labels)) | F.col(gold).isNull())
    if not strays.isEmpty():
        raise ValueError("labels outside the model's classes")

    def best(grid):
        losses = {r["temperature"]: r["nll"] for r in temperature_losses(df, grid, labels, gold, logits).collect()}
        return min(((losses[t], i, t) for i, t in enumerate(grid) if t in losses), default=(float("inf"), 0, 1.0))

    coarse = best(coarse_grid())
    fine = best(fine_grid(coarse[2]))
    return max(MIN_TEMPERATURE, fine[2] if fine[0] < coarse[0] else coarse[2])
