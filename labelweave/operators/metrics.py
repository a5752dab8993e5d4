"""Classification metrics.

One aggregation reduces any number of predictions to the (slice, gold, pred) count table; every metric below is
arithmetic on that table, whose size is slices x labels^2 whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import is_blank, strip
from labelweave.schema import LABELS

EMPTY_SLICE = "__EMPTY__"


def count_table(df: DataFrame, by: Sequence[str] = (), gold: str = "label", pred: str = "pred_label") -> DataFrame:
    return (df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def only_labelled(df: DataFrame, gold: str = "label", pred: str = "pred_label") -> DataFrame:
    """Rows that can be evaluated: gold and prediction present."""
    return df.where(~is_blank(gold) & ~is_blank(pred))


def marginals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label: hits, gold rows and predicted rows. The labels are those seen as gold or as prediction."""
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("gold_n"), zero.alias("pred_n"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("pred").alias("label"), zero.alias("gold_n"), F.col("n").alias("pred_n"), zero.alias("hits")),
    )
    return (counts.select(*by, F.inline(sides))
            .groupBy(*by, "label")
            .agg(*[F.sum(c).alias(c) for c in ("gold_n", "pred_n", "hits")]))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy and macro-F1 per slice; null metrics when there are no rows."""
    f1 = _ratio(2 * F.col("hits"), F.col("gold_n") + F.col("pred_n"))
    return marginals(counts, by).groupBy(*by).agg(
        F.coalesce(F.sum("gold_n"), F.lit(0)).alias("n"),
        (F.sum("hits") / F.nullif(F.sum("gold_n"), F.lit(0))).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
    )


def report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label, followed by macro and weighted averages."""
    per_label = marginals(counts, by).select(
        *by, "label",
        _ratio(F.col("hits"), F.col("pred_n")).alias("precision"),
        _ratio(F.col("hits"), F.col("gold_n")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("gold_n") + F.col("pred_n")).alias("f1"),
        F.col("gold_n").alias("support"),
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = per_label.groupBy(*by).agg(F.array(
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], total.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[(F.sum(F.col(s) * F.col("support")) / total).alias(s) for s in scores], total.alias("support")),
    ).alias("rows")).select(*by, F.inline("rows")).where("support is not null")
    return per_label.unionByName(averages)


def confusion(counts: DataFrame, labels: Sequence[str] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """One row per gold label in list order, one column per predicted label; labels off the list are ignored."""
    def cell(gold, pred):
        hit = (F.col("gold") == gold) & (F.col("pred") == pred)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"pred_{pred}")

    rows = F.array(*[F.struct(F.lit(g).alias("gold"), *[cell(g, p) for p in labels]) for g in labels])
    return counts.groupBy(*by).agg(rows.alias("rows")).select(*by, F.inline("rows"))


def per_slice(df: DataFrame, slice_column: str, gold: str = "label", pred: str = "pred_label") -> DataFrame:
    """Metrics per value of a column; a blank value is its own slice."""
    name = F.when(is_blank(slice_column), EMPTY_SLICE).otherwise(strip(F.col(slice_column).cast("string")))
    rows = only_labelled(df, gold, pred).select(name.alias("slice"), gold, pred)
    return summary(count_table(rows, ["slice"], gold, pred), ["slice"])


def overall_and_per_category(df: DataFrame, category: str = "category", gold: str = "label",
                             pred: str = "pred_label") -> DataFrame:
    """Overall and per-category metrics from one pass: the overall rows are folded from the count table."""
    counts = count_table(df, [category], gold, pred)
    scoped = counts.select(
        F.inline(F.array(
            F.struct(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("category")),
            F.struct(F.lit("category").alias("scope"), F.col(category).cast("string").alias("category")),
        )), "gold", "pred", "n")
    return summary(scoped, ["scope", "category"])


def per_language(df: DataFrame, lang: str = "lang", gold: str = "label", pred: str = "pred_label") -> DataFrame:
    """Long-form metrics keyed like ``accuracy__en``; only languages present in the data."""
    rows = df.where(~is_blank(lang)).withColumn("_lang", F.lower(strip(lang)))
    scores = summary(count_table(rows, ["_lang"], gold, pred), ["_lang"])
    return scores.select(F.inline(F.array(*[
        F.struct(F.concat(F.lit(f"{m}__"), F.col("_lang")).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy", "f1_macro")])))


def label_universe(df: DataFrame, gold: str = "label", pred: str = "pred_label") -> DataFrame:
    """Distinct labels used as gold or as prediction."""
    return (df.select(F.explode(F.array(gold, pred)).alias("label")).where(F.col("label").isNotNull()).distinct())


def distribution(df: DataFrame, column: str = "label", known: Sequence[str] = ()) -> DataFrame:
    """Counts per value; known values are present even when the data has none of them."""
    counts = df.groupBy(F.col(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    if not known:
        return counts
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias(column))
    zeros = listed.withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def label_language_distribution(df: DataFrame, label: str = "label", lang: str = "lang") -> DataFrame:
    lower = F.lower(F.coalesce(F.col(lang), F.lit("unk")))
    return df.groupBy(F.col(label).alias("label"), lower.alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, labels: Sequence[str] = LABELS, label: str = "label") -> DataFrame:
    """Balanced weights total / (k * count); an absent class weighs 0."""
    counts = [F.count(F.when(F.col(label) == l, 1)) for l in labels]
    total = F.count(F.when(F.col(label).isin(list(labels)), 1))
    rows = F.array(*[F.struct(F.lit(l).alias("label"), n.alias("n"),
                              F.when(n > 0, total / (len(labels) * n)).otherwise(0.0).alias("weight"))
                     for l, n in zip(labels, counts)])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def weight_of(label: Column | str, mapping: dict[str, float]) -> Column:
    """Look-up of a given label-to-weight map; labels without an entry weigh 1."""
    c = F.col(label) if isinstance(label, str) else label
    if not mapping:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k).upper()), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, c), F.lit(1.0))
