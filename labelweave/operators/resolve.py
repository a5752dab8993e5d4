"""From several labels per item to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import is_blank
from labelweave.schema import LABELS

STRATEGIES = ("drop_unresolved", "majority", "annotator_priority")


def _votes(labels: Sequence[str]) -> list[Column]:
    return [F.count(F.when(F.col("label") == l, 1)).alias(f"_votes_{i}") for i, l in enumerate(labels)]


def _vote_array(labels: Sequence[str]) -> Column:
    """(votes, label) entries, most votes first."""
    return F.sort_array(F.array(*[
        F.struct(F.col(f"_votes_{i}").alias("votes"), F.lit(l).alias("label")) for i, l in enumerate(labels)
    ]), asc=False)


def _majority() -> Column:
    top, second = F.col("_ranked")[0], F.col("_ranked")[1]
    return F.when(top["votes"] > second["votes"], top["label"])


def _folded(anns: DataFrame, labels: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """Votes, representative text and the listed annotators' last labels, one row per item.

    Two levels: rows first fold per (id, text length), then per id. Both levels combine map-side, so an item that
    owns a large share of all rows never meets in one task unreduced. The text is the longest non-blank one, the
    first of those on a tie.
    """
    names = [f"_by_{i}" for i in range(len(priority))]
    size = F.when(is_blank("text"), 0).otherwise(F.length("text"))
    by_size = anns.withColumn("_size", size).groupBy("id", "_size").agg(
        *_votes(labels),
        F.min_by("text", "seq").alias("text"),
        *[F.max(F.when(F.col("annotator") == who, F.struct("seq", "label"))).alias(n) for n, who in zip(names, priority)],
    )
    return by_size.groupBy("id").agg(
        *[F.sum(f"_votes_{i}").alias(f"_votes_{i}") for i in range(len(labels))],
        F.max_by(F.when(F.col("_size") > 0, F.col("text")).otherwise(""), "_size").alias("text"),
        *[F.max(n)["label"].alias(n) for n in names],
    ).withColumn("_ranked", _vote_array(labels))


def representative_texts(anns: DataFrame) -> DataFrame:
    return _folded(anns, LABELS, ()).select("id", "text")


def resolve(anns: DataFrame, strategy: str = "drop_unresolved", decisions: DataFrame | None = None,
            priority: Sequence[str] = (), groups: DataFrame | None = None,
            labels: Sequence[str] = LABELS) -> DataFrame:
    """One label per item: decision, else unanimity, else the strategy; ``label`` is null when none applies.

    The strategy only adds aggregates to one groupBy, so the state per item is a few counters and one text however
    many annotations an item has. ``how`` tells which rule decided.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    listed = priority if strategy == "annotator_priority" else ()
    items = _folded(anns, labels, listed)
    items = items.withColumn("_valid", sum(F.col(f"_votes_{i}") for i in range(len(labels)))).where("_valid > 0")

    unanimous = F.when(F.col("_ranked")[0]["votes"] == F.col("_valid"), F.col("_ranked")[0]["label"])
    chosen = [F.when(F.col(f"_by_{i}").isin(list(labels)), F.col(f"_by_{i}")) for i in range(len(listed))]
    nothing = F.lit(None).cast("string")
    fallback = {
        "drop_unresolved": nothing,
        "majority": _majority(),
        "annotator_priority": F.coalesce(*chosen, nothing),
    }[strategy]
    if decisions is not None:
        latest = decisions.groupBy("id").agg(F.max_by("final_label", "seq").alias("_decided"))
        items = items.join(latest, "id", "left")
    else:
        items = items.withColumn("_decided", F.lit(None).cast("string"))
    if groups is not None:
        items = items.join(groups.select("id", "group"), "id", "left")
    else:
        items = items.withColumn("group", F.lit(None).cast("string"))
    how = (F.when(F.col("_decided").isNotNull(), "decision").when(unanimous.isNotNull(), "unanimous")
           .when(fallback.isNotNull(), strategy).otherwise("unresolved"))
    return items.select("id", "text", F.coalesce("_decided", unanimous, fallback).alias("label"), "group",
                        how.alias("how"))


def resolved_only(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("label").isNotNull()).drop("how")


def unresolved_count(resolved: DataFrame) -> DataFrame:
    """Rows per deciding rule, the unresolved ones included."""
    return resolved.groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def majority(anns: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Strict majority of all annotation rows of an item; ties are left out."""
    return (anns.groupBy("id").agg(*_votes(labels)).withColumn("_ranked", _vote_array(labels))
            .select("id", _majority().alias("label"), F.col("_ranked")[0]["votes"].alias("votes"))
            .where("label is not null"))


def attach_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    return items.drop("group").join(groups.select("id", "group"), "id", "left")
