"""Prediction sets with a coverage target."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions import proba as P
from labelweave.operators.ordering import value_at_rank
from labelweave.schema import LABELS

DEFAULT_TAU = 0.5


def nonconformity(df: DataFrame, labels: Sequence[str] = LABELS, gold: str = "label", proba: str = "proba") -> DataFrame:
    """1 - p(gold) per row; a label the model does not know stops the job."""
    known = F.col(gold).isin(list(labels))
    score = F.when(known, 1.0 - F.element_at(F.col(proba), F.col(gold))).otherwise(
        F.raise_error(F.concat(F.lit("unknown label in calibration rows: "), F.coalesce(gold, F.lit("null")))))
    return df.select(score.alias("score"))


def fitted_tau(df: DataFrame, coverage: float = 0.9, labels: Sequence[str] = LABELS, gold: str = "label",
               proba: str = "proba", exact: bool = True) -> tuple[float | None, int]:
    """(tau, n): the score at 0-based rank ceil(q(n-1)) with q = ceil((n+1) coverage)/n, clipped to [0, 1]."""
    level = 1.0 - (1.0 - float(coverage))
    scores = nonconformity(df, labels, gold, proba)

    def rank(n):
        q = min(1.0, max(0.0, math.ceil((n + 1) * level) / n))
        return math.ceil(q * (n - 1))

    if exact:
        return value_at_rank(scores, "score", rank)
    return tuple(scores.agg(F.percentile_approx("score", F.lit(level), F.lit(10_000)), F.count("score")).first())


def tau_table(df: DataFrame, coverage: float = 0.9, **options) -> DataFrame:
    tau, n = fitted_tau(df, coverage, **options)
    return df.sparkSession.range(1).select(F.lit(tau).cast("double").alias("tau"), F.lit(n).cast("long").alias("n"))


def fit_tau(calibration: DataFrame | None, labelled_input: DataFrame | None = None, coverage: float = 0.9, **options) -> float:
    """Tau from calibration rows, else from the labelled input, else the default."""
    for rows in (calibration, labelled_input):
        tau = fitted_tau(rows, coverage, **options)[0] if rows is not None else None
        if tau is not None:
            return float(tau)
    return DEFAULT_TAU


def prediction_sets(df: DataFrame, tau, labels: Sequence[str] = LABELS, proba: str = "proba") -> DataFrame:
    """Adds ``pred_set`` (labels with 1 - p <= tau) and ``set_size``."""
    out = df.withColumn("pred_set", P.conformal_set(proba, tau, labels))
    return out.withColumn("set_size", F.size("pred_set"))


def coverage(df: DataFrame, gold: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of labelled rows whose set holds the gold label, and the mean set size; 0 without labelled rows."""
    labelled = df.where(F.col(gold).isNotNull() & (F.col(gold) != ""))
    hit = F.array_contains("pred_set", F.col(gold)).cast("double")
    return labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.avg("set_size"), F.lit(0.0)).alias("mean_size"))
