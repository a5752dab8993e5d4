"""Dataset checks: row-local rules, cross-row rules and the summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import code_switch, is_blank, strip, upper_label
from labelweave.operators.ordering import previous_value
from labelweave.schema import LABELS, SPLITS, require_columns

REQUIRED = ("id", "text", "label")


def missing_columns(df: DataFrame, optional: Sequence[str | None] = ()) -> DataFrame:
    """Per column that is required, or was named, but is absent: the number of rows without it."""
    absent = [c for c in (*REQUIRED, *[o for o in optional if o]) if c not in df.columns]
    names = F.array(*[F.lit(c) for c in absent]) if absent else F.array().cast("array<string>")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.explode(names).alias("column"), F.lit("missing column").alias("rule"), "rows")


def _text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def row_issues(label: str = "label", lang: str | None = None, split: str | None = None,
               labels: Sequence[str] = LABELS, langs: Sequence[str] = (),
               allow_extra_labels: bool = False, allow_extra_langs: bool = False) -> Column:
    """Array of (rule, detail) found by looking at one row only; batch and stream share it."""
    def issue(condition: Column, rule: str, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    nothing = F.lit("")
    found = [
        issue(_text_of("id") == "", "empty id", nothing),
        issue(is_blank(_text_of("text")), "empty text", nothing),
    ]
    value = upper_label(_text_of(label))
    found.append(issue(value == "", "empty label", nothing))
    if not allow_extra_labels:
        found.append(issue((value != "") & ~value.isin(list(labels)), "invalid label", value))
    if lang:
        value = F.lower(strip(_text_of(lang)))
        found.append(issue(value == "", "empty lang", nothing))
        if langs and not allow_extra_langs:
            found.append(issue((value != "") & ~value.isin([l.lower() for l in langs]), "invalid lang", value))
    if split:
        value = F.lower(strip(_text_of(split)))
        found.append(issue(value == "", "empty split", nothing))
        found.append(issue((value != "") & ~value.isin(list(SPLITS)), "invalid split", value))
    return F.array_compact(F.array(*found))


def row_level(df: DataFrame, **rules) -> DataFrame:
    require_columns(df, REQUIRED)
    return df.select("seq", "id", F.inline(row_issues(**rules)))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Second and later occurrences of an id.

    The first occurrence per id comes from a map-side combined minimum, so copies of one id are compared with a
    single value instead of being ranked together in one task.
    """
    keyed = df.select("seq", _text_of("id").alias("id"))
    first = keyed.groupBy("id").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (keyed.join(first, "id").where(F.col("seq") != F.col("first"))
            .select("seq", "id", F.lit("duplicate id").alias("rule"), F.lit("").alias("detail")))


def split_conflicts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows whose split differs from the previous valid split of the same id.

    Ids that stay within one split are ruled out by an aggregate first; only ids that change are ordered.
    """
    value = F.lower(strip(_text_of(split)))
    rows = df.select("seq", _text_of("id").alias("id"), value.alias("split")).where(F.col("split").isin(list(SPLITS)))
    changing = (rows.groupBy("id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
                .where("a <> b").select("id"))
    before = previous_value(rows.join(changing, "id", "left_semi"), "id", "split")
    return (before.where("before <> split")
            .select("seq", "id", F.lit("several splits").alias("rule"),
                    F.concat_ws(" -> ", "before", "split").alias("detail")))


def group_leakage(df: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """Groups that occur in more than one split; an invalid split name counts as a split too."""
    g, s = strip(_text_of(group)), F.lower(strip(_text_of(split)))
    pairs = df.select(g.alias("group"), s.alias("split")).where("group <> '' and split <> ''").distinct()
    return (pairs.groupBy("group").agg(F.sort_array(F.collect_set("split")).alias("_splits"))
            .where(F.size("_splits") > 1)
            .select("group", F.array_join("_splits", ",").alias("splits"), F.size("_splits").alias("n_splits")))


def splits_disjoint(df: DataFrame, group: str = "group", split: str = "split") -> bool:
    return group_leakage(df, group, split).isEmpty()


def issues(df: DataFrame, group: str | None = None, lang: str | None = None, split: str | None = None,
           **rules) -> DataFrame:
    """All issues as (seq, id, rule, detail); a group warning has no row and no id."""
    out = row_level(df, lang=lang, split=split, **rules).unionByName(duplicate_ids(df))
    if split:
        out = out.unionByName(split_conflicts(df, split))
    if split and group:
        seq_type = df.schema["seq"].dataType
        out = out.unionByName(group_leakage(df, group, split).select(
            F.lit(None).cast(seq_type).alias("seq"), F.lit(None).cast("string").alias("id"),
            F.lit("group spans splits").alias("rule"),
            F.concat_ws(": ", "group", "splits").alias("detail")))
    return out


def verdict(found: DataFrame) -> DataFrame:
    """PASSED unless something other than a warning was found."""
    errors = F.count(F.when(F.col("rule") != "group spans splits", 1))
    return found.agg(F.count(F.lit(1)).alias("issues"), errors.alias("errors")).withColumn(
        "verdict", F.when(F.col("errors") == 0, "PASSED").otherwise("FAILED"))


def shown_issues(found: DataFrame, limit: int = 500) -> DataFrame:
    """The head of the issue report; ``verdict`` keeps the full count."""
    return found.orderBy(F.col("seq").asc_nulls_last(), "rule", "detail").limit(limit)


def summary(df: DataFrame, group: str | None = None) -> DataFrame:
    """Totals of a dataset in one row.

    Distinct ids are counted from a grouped table, which combines map-side, not from a single-task set.
    """
    per_id = (df.groupBy(_text_of("id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_blank(_text_of("text")), 1)).alias("blank"),
        (F.count(F.when(~is_blank(_text_of(group)), 1)) if group else F.lit(None).cast("long")).alias("grouped")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    blank = F.coalesce(F.sum("blank"), F.lit(0))
    return per_id.agg(
        total.alias("total_rows"), F.count(F.lit(1)).alias("unique_ids"),
        (total - F.count(F.lit(1))).alias("duplicate_ids"), blank.alias("empty_text"),
        F.when(total > 0, blank / total * 100.0).otherwise(0.0).alias("empty_text_pct"),
        F.sum("grouped").alias("group_nonempty"))


def distributions(df: DataFrame, lang: str | None = None, split: str | None = None,
                  langs: Sequence[str] = ()) -> DataFrame:
    """(dimension, value, n) for label, code-switch class and, when named, language and split.

    The rows are counted once per combination; the dimensions fold from that small table. Listed languages appear
    with 0 when the data has none.
    """
    text = _text_of("text")
    dims = {"label": upper_label(_text_of("label")),
            "codeswitch": F.when(text != "", code_switch(text))}
    if lang:
        dims["lang"] = F.lower(strip(_text_of(lang)))
    if split:
        dims["split"] = F.lower(strip(_text_of(split)))
    cells = df.select(*[c.alias(k) for k, c in dims.items()]).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value"), F.col("n").alias("n")) for k in dims])))
    if lang and langs:
        zero = df.sparkSession.range(1).select(
            F.lit("lang").alias("dimension"), F.explode(F.array(*[F.lit(l) for l in langs])).alias("value"),
            F.lit(0).cast("long").alias("n"))
        rows = rows.unionByName(zero)
    return rows.where("value is not null").groupBy("dimension", "value").agg(F.sum("n").alias("n"))
