"""Who agrees with whom: annotator pairs, disagreement queues and kappa."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelweave.functions.labels import is_blank, strip
from labelweave.schema import LABELS


def latest_annotations(anns: DataFrame, keep: Sequence[str] = ("text",), first: str = "seq") -> DataFrame:
    """Last label wins per (id, annotator); ``pos`` stays the first occurrence.

    Grouping on both keys lets map-side combine shrink an item that holds many repeated rows before the shuffle.
    """
    last = F.max_by(F.struct("label", *keep), "seq")
    return (anns.groupBy("id", "annotator").agg(last.alias("last"), F.min(first).alias("pos"))
            .select("id", "annotator", "pos", "last.*"))


def _pairs(anns: DataFrame, same: bool, first: str) -> DataFrame:
    slim = latest_annotations(anns.withColumn("size", F.length("text")), keep=("size", "seq"), first=first)
    a, b = slim.alias("a"), slim.alias("b")
    match = F.col("a.label") == F.col("b.label")
    longer_a = F.col("a.size") >= F.col("b.size")
    paired = a.join(
        b,
        (F.col("a.id") == F.col("b.id")) & (F.col("a.pos") < F.col("b.pos")) & (match if same else ~match),
    ).select(
        F.col("a.id").alias("id"),
        F.col("a.annotator").alias("annotator_a"), F.col("a.label").alias("label_a"),
        F.col("b.annotator").alias("annotator_b"), F.col("b.label").alias("label_b"),
        F.when(longer_a, F.col("a.annotator")).otherwise(F.col("b.annotator")).alias("_from"),
        F.when(longer_a, F.col("a.seq")).otherwise(F.col("b.seq")).alias("_seq"),
    )
    # Only lengths take part so far. Texts join by the row they come from, a key no two rows share, so they move once
    # at most and a heavily annotated item does not gather in one task.
    texts = anns.select("id", F.col("annotator").alias("_from"), F.col("seq").alias("_seq"), "text")
    return (paired.join(texts, ["id", "_from", "_seq"])
            .select("id", "text", "annotator_a", "label_a", "annotator_b", "label_b"))


def disagreements(anns: DataFrame, first: str = "seq") -> DataFrame:
    """All unordered annotator pairs of an item with different labels; the longer text represents the pair."""
    return _pairs(anns, False, first)


def agreements(anns: DataFrame, first: str = "seq") -> DataFrame:
    return _pairs(anns, True, first)


def queue_new(queue: DataFrame, logged: DataFrame, key: str = "id") -> DataFrame:
    """Items not in the log yet."""
    return queue.join(logged.select(key), key, "left_anti")


def first_two(anns: DataFrame) -> DataFrame:
    """Labels of the first two annotators of each item, as columns label_a and label_b.

    The rank limit is pushed below the shuffle, so a heavily annotated item sends two rows per task.
    """
    latest = latest_annotations(anns, keep=())
    order = W.partitionBy("id").orderBy("pos", "annotator")
    ranked = latest.withColumn("rank", F.row_number().over(order)).where("rank <= 2")

    def label_at(rank):
        return F.max(F.when(F.col("rank") == rank, F.col("label")))

    return (ranked.groupBy("id").agg(label_at(1).alias("label_a"), label_at(2).alias("label_b"))
            .where("label_b is not null"))


def _kappa_sums(labels: Sequence[str], only_listed: bool) -> dict:
    listed = F.col("label_a").isin(list(labels)) & F.col("label_b").isin(list(labels))
    n = F.when(listed, F.col("n")) if only_listed else F.col("n")

    def side(column, label):
        return F.coalesce(F.sum(F.when(F.col(column) == label, n)), F.lit(0))

    sums = {"_n": F.sum(n), "_same": F.coalesce(F.sum(F.when(F.col("label_a") == F.col("label_b"), n)), F.lit(0))}
    for i, l in enumerate(labels):
        sums[f"_a{i}"], sums[f"_b{i}"] = side("label_a", l), side("label_b", l)
    return sums


def kappa(pair_counts: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = LABELS,
          mode: str = "iaa") -> DataFrame:
    """Cohen's kappa from a (by, label_a, label_b, n) table.

    ``adjudication`` drops pairs with a label off the list and calls full chance agreement 1;
    ``iaa`` counts every pair and leaves full chance agreement undefined (NaN).
    """
    if mode not in ("iaa", "adjudication"):
        raise ValueError(f"unknown kappa mode {mode!r}")
    sums = _kappa_sums(labels, only_listed=mode == "adjudication")
    out = pair_counts.groupBy(*by).agg(*[c.alias(k) for k, c in sums.items()])
    n = F.col("_n")
    expected = sum((F.col(f"_a{i}") / n) * (F.col(f"_b{i}") / n) for i in range(len(labels)))
    at_one = F.lit(1.0 if mode == "adjudication" else float("nan"))
    value = (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(float("nan")))
             .when(F.col("_pe") == 1.0, at_one)
             .otherwise((F.col("_same") / n - F.col("_pe")) / (1 - F.col("_pe"))))
    return (out.withColumn("_pe", F.when(F.coalesce(n, F.lit(0)) > 0, expected))
            .select(*by, F.coalesce(n, F.lit(0)).alias("n"), F.col("_same").alias("agreements"), value.alias("kappa")))


def first_two_counts(anns: DataFrame) -> DataFrame:
    return first_two(anns).groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def agreement_summary(anns: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Items compared, agreements, agreement share and kappa over the first two annotators of each item."""
    counts = first_two_counts(anns)
    return kappa(counts, (), labels, "adjudication").select(
        F.col("n").alias("items"), "agreements",
        F.when(F.col("n") > 0, F.col("agreements") / F.col("n")).alias("agreement"), "kappa")


def annotator_pairs(anns: DataFrame, lang: str | None = None) -> DataFrame:
    """(annotator_a < annotator_b, label_a, label_b, id [, lang]) over common items, blank cells skipped."""
    usable = anns.where(~is_blank("id") & ~is_blank("annotator") & ~is_blank("label")).withColumn(
        "label", F.upper(strip("label")))
    latest = latest_annotations(usable, keep=())
    if lang:
        # The language of an item is its last non-blank one.
        langs = (usable.where(~is_blank(lang)).groupBy("id")
                 .agg(F.max_by(F.lower(strip(lang)), F.col("seq")).alias("lang")))
        latest = latest.join(langs, "id", "left")
    else:
        latest = latest.withColumn("lang", F.lit(None).cast("string"))
    a, b = latest.alias("a"), latest.alias("b")
    return a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.annotator") < F.col("b.annotator"))).select(
        F.col("a.id").alias("id"), F.col("a.lang").alias("lang"),
        F.col("a.annotator").alias("annotator_a"), F.col("b.annotator").alias("annotator_b"),
        F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


def kappa_per_pair(anns: DataFrame, lang: str | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Kappa per annotator pair, and per language too when a language column is named."""
    by = (["lang"] if lang else []) + ["annotator_a", "annotator_b"]
    pairs = annotator_pairs(anns, lang)
    if lang:
        pairs = pairs.where(F.col("lang").isNotNull())
    counts = pairs.groupBy(*by, "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    return kappa(counts, by, labels, "iaa")


def common_items(anns: DataFrame, a: str, b: str) -> DataFrame:
    """Ids labelled by both annotators."""
    def items_of(who):
        return anns.where(F.col("annotator") == who).select("id")

    return items_of(a).intersect(items_of(b))
