"""From raw annotations to a checked, split dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions import labels as L
from labelweave.operators import agreement as A
from labelweave.operators import metrics as M
from labelweave.operators import quality as Q
from labelweave.operators import resolve as R
from labelweave.operators import sampling as S
from labelweave.schema import LABELS
from labelweave.sinks import tables as sinks
from labelweave.sources import tables as sources

RATIOS = (0.8, 0.1, 0.1)


def combine(anns: DataFrame, strategy: str = "drop_unresolved", decisions: DataFrame | None = None,
            groups: DataFrame | None = None, priority: Sequence[str] = (), ratios=RATIOS, seed: int = 42,
            by_group: bool = False) -> tuple[DataFrame, DataFrame]:
    """One label per item, then a split: (final rows with ``split``, counts per deciding rule)."""
    resolved = R.resolve(anns, strategy, decisions, priority, groups)
    final = R.resolved_only(resolved)
    split = (S.group_split_or_stratified if by_group else S.stratified_split)(final, *ratios, seed=seed)
    return split, R.unresolved_count(resolved)


def split_dataset(df: DataFrame, ratios=RATIOS, seed: int = 42, by_group: bool = False) -> DataFrame:
    rows = sources.final_dataset(df)
    return (S.group_split_or_stratified if by_group else S.stratified_split)(rows, *ratios, seed=seed)


def ingest(df: DataFrame, group: str | None = None, lang: str | None = None, ratios=RATIOS, seed: int = 42,
           **rules) -> tuple[DataFrame, DataFrame]:
    """Checked and cleaned rows, resolved by majority and split: (final rows, issues).

    Rows without an annotator all belong to one.
    """
    found = Q.issues(df, group=group, lang=lang, **rules)
    clean = sinks.clean_copy(df)
    if "annotator" not in clean.columns:
        clean = clean.withColumn("annotator", F.lit("single"))
    groups = None
    if group:
        groups = clean.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(group, "seq").alias("group"))
    final, _ = combine(sources.annotations(clean), "majority", groups=groups, ratios=ratios, seed=seed,
                       by_group=group is not None)
    return final, found


def queue(anns: DataFrame, logged: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Disagreements that are not in the log yet, with the note to append."""
    pairs = A.disagreements(anns)
    if logged is not None:
        pairs = A.queue_new(pairs, logged)
    if limit > 0:
        pairs = pairs.orderBy("id", "annotator_a", "annotator_b").limit(limit)
    return pairs.withColumn("note", L.adjudication_note(F.col("id").cast("string"), "text", "label_a", "label_b"))


def agreement(anns: DataFrame, lang: str | None = None, labels: Sequence[str] = LABELS) -> dict[str, DataFrame]:
    out = {"summary": A.agreement_summary(anns, labels), "matrix": A.first_two_counts(anns),
           "pairs": A.kappa_per_pair(anns, None, labels)}
    if lang:
        out["pairs_by_lang"] = A.kappa_per_pair(anns, lang, labels)
    return out


def publish(final: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the dataset by split; returns the label distribution of what was written."""
    kept = sinks.final_columns(final)
    sinks.write_splits(final.select(*kept.columns, "split"), path, fmt)
    return M.distribution(final, "label", LABELS)
