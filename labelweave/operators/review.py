"""Choosing what people should look at next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions import proba as P
from labelweave.functions.labels import number, strip, upper_label
from labelweave.schema import LABELS, keyed_hash


def with_confidence(df: DataFrame, proba: str = "proba") -> DataFrame:
    return df.withColumns({"confidence": P.confidence(proba), "margin": P.margin(proba)})


def misclassified(df: DataFrame) -> DataFrame:
    """Wrong rows, the least certain first."""
    return df.where(F.col("label") != F.col("pred_label")).orderBy("margin", "confidence", "id")


def fill_uncertainty(df: DataFrame, labels=LABELS) -> DataFrame:
    """Numbers of an error table: blanks count as 0, and confidence and margin are rebuilt together from the
    probabilities when either is 0 and any probability is known."""
    def num(c: str) -> Column:
        return F.coalesce(number(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    values = [num(f"proba_{l}") for l in labels]
    ordered = F.sort_array(F.array(*values), asc=False)
    confidence, margin = num("confidence"), num("margin")
    rebuild = ((confidence == 0.0) | (margin == 0.0)) & (F.array_max(F.transform(F.array(*values), F.abs)) > 0)
    return df.select(
        strip("id").alias("id"), strip("text").alias("text"),
        upper_label("label").alias("label"), upper_label("pred_label").alias("pred_label"),
        *[v.alias(f"proba_{l}") for v, l in zip(values, labels)],
        F.when(rebuild, ordered[0]).otherwise(confidence).alias("confidence"),
        F.when(rebuild, ordered[0] - ordered[1]).otherwise(margin).alias("margin"))


ORDERINGS = {
    "uncertain": lambda seed: [F.col("margin").asc(), F.col("confidence").desc(), F.col("id")],
    "confident_wrong": lambda seed: [F.col("confidence").desc(), F.col("margin").desc(), F.col("id")],
    "random": lambda seed: [keyed_hash(seed, "id"), F.col("id")],
}


def register_ordering(name: str, columns) -> None:
    """Add a strategy: a function from seed to ordering columns."""
    ORDERINGS[name] = columns


def review_queue(errors: DataFrame, strategy: str = "uncertain", limit: int = 0, seed: int = 42) -> DataFrame:
    """Error rows by priority; a limit above 0 keeps the first ones (top-k, not a full sort)."""
    if strategy not in ORDERINGS:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(ORDERINGS)}")
    ordered = errors.orderBy(*ORDERINGS[strategy](seed))
    return ordered.limit(limit) if limit > 0 else ordered


def review_columns(queue: DataFrame) -> DataFrame:
    return queue.select("id", "text", F.col("label").alias("gold_label"), F.col("pred_label").alias("model_label"),
                        F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))
