"""Expressions on label-keyed probability maps. Probabilities are never addressed by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.functions.labels import as_column
from labelweave.schema import LABELS

# Floor of the logarithm in the entropy and in the negative log-likelihood.
EPSILON = 1e-12


def proba_from_columns(labels: Sequence[str] = LABELS, prefix: str = "proba_") -> Column:
    return F.create_map(*[x for l in labels for x in (F.lit(l), F.col(f"{prefix}{l}").cast("double"))])


def proba_to_columns(proba: Column | str = "proba", labels: Sequence[str] = LABELS, prefix: str = "proba_") -> list[Column]:
    return [F.element_at(as_column(proba), F.lit(l)).alias(f"{prefix}{l}") for l in labels]


def softmax(logits: Column | str, temperature: float | Column = 1.0) -> Column:
    """Max-shifted softmax of a label-keyed logit map."""
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    logits = as_column(logits)
    top = F.array_max(F.map_values(logits))
    grown = F.transform_values(logits, lambda _, v: F.exp((v - top) / t))
    total = F.aggregate(F.map_values(grown), F.lit(0.0), lambda acc, v: acc + v)
    return F.transform_values(grown, lambda _, v: v / total)


def argmax_label(proba: Column | str) -> Column:
    """Most probable label; ties go to the first label in name order."""
    ranked = F.transform(F.map_entries(as_column(proba)), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label")))
    return F.array_min(ranked)["label"]


def _descending(proba) -> Column:
    return F.sort_array(F.map_values(as_column(proba)), asc=False)


def confidence(proba: Column | str) -> Column:
    return F.coalesce(F.array_max(F.map_values(as_column(proba))), F.lit(0.0))


def margin(proba: Column | str) -> Column:
    p = _descending(proba)
    return F.coalesce(F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)), F.lit(0.0))


def entropy(proba: Column | str) -> Column:
    return F.aggregate(F.map_values(as_column(proba)), F.lit(0.0), lambda acc, p: acc - p * F.log(p + EPSILON))


def conformal_set(proba: Column | str, tau: float | Column, labels: Sequence[str] = LABELS) -> Column:
    """Labels with 1 - p <= tau, in display order."""
    tau = F.lit(tau) if not isinstance(tau, Column) else tau
    proba = as_column(proba)
    return F.array_compact(F.array(*[F.when(1.0 - F.element_at(proba, F.lit(l)) <= tau, F.lit(l)) for l in labels]))


def top_classes(proba: Column | str, k: int) -> Column:
    """The k (1 to 5) most probable labels as an array of (label, prob)."""
    ranked = F.sort_array(F.transform(
        F.map_entries(as_column(proba)),
        lambda e: F.struct((-e["value"]).alias("negated"), e["key"].alias("label")),
    ))
    return F.transform(
        F.slice(ranked, 1, max(1, min(5, int(k)))),
        lambda e: F.struct(e["label"].alias("label"), (-e["negated"]).alias("prob")),
    )


def squared_error(proba: Column | str, gold: Column | str) -> Column:
    """Sum over classes of (p - onehot)^2, the per-row Brier term."""
    gold = as_column(gold)
    return F.aggregate(
        F.map_entries(as_column(proba)), F.lit(0.0),
        lambda acc, e: acc + F.pow(e["value"] - F.when(e["key"] == gold, 1.0).otherwise(0.0), F.lit(2.0)),
    )


def log_loss(proba: Column | str, gold: Column | str) -> Column:
    p = F.element_at(as_column(proba), as_column(gold))
    return -F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0)))
