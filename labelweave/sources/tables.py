"""Tabular inputs: CSV, Parquet or JSON lines with a header-driven schema of strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.labels import annotation_label, blank_to_null, canonical_split, is_blank, strip, upper_label
from labelweave.operators.review import fill_uncertainty
from labelweave.schema import LABELS, SPLITS, rename_case_insensitive, require_columns, row_place


def file_format(path: str) -> str:
    """csv, json or parquet, by extension; a folder without one holds Parquet."""
    last = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ext in ("csv", "json", "parquet"):
        if last.endswith("." + ext):
            return ext
    if "." in last and not last.startswith("."):
        raise ValueError(f"unsupported input extension: {path}")
    return "parquet"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, with_seq: bool = False, multiline: bool = True,
               source_no: int = 0) -> DataFrame:
    """The file's columns, and with ``with_seq`` the place of each row.

    Multi-line CSV keeps a file in one task; pass ``multiline=False``, or Parquet, for very large files.
    """
    fmt = fmt or file_format(path)
    reader = spark.read
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", multiline).option("escape", '"')
                  .option("encoding", "UTF-8").option("enforceSchema", False))
    df = reader.format(fmt).load(path)
    if with_seq:
        place = row_place(source_no, F.col("_metadata.file_path"), F.monotonically_increasing_id())
        df = df.select("*", place.alias("seq"))
    return df.withColumnsRenamed({c: c.strip().lstrip("\ufeff") for c in df.columns})


def _text(c: str) -> Column:
    return strip(F.col(c).cast("string")).alias(c)


def labelled(df: DataFrame, group: str | None = "group", lang: str | None = "lang", split: str | None = "split",
             source: str | None = "source") -> DataFrame:
    """id, text, label and the optional columns that exist; blanks of those are null."""
    require_columns(df, ("id", "text", "label"))
    out = [F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"),
           upper_label(F.col("label").cast("string")).alias("label")]
    for name, column in (("group", group), ("lang", lang), ("split", split), ("source", source)):
        if column and column in df.columns:
            out.append(blank_to_null(F.col(column).cast("string")).alias(name))
    if "seq" in df.columns:
        out.append(F.col("seq"))
    return df.select(*out)


def with_known_split(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows routed to train, val or test; other split names are left out."""
    return df.withColumn("split", canonical_split(split)).where(F.col("split").isNotNull())


def read_split_files(spark: SparkSession, train: str, val: str, test: str, **options) -> DataFrame:
    """Three predefined files as one tagged table."""
    parts = [labelled(read_table(spark, p, **options), split=None).withColumn("split", F.lit(s))
             for s, p in zip(SPLITS, (train, val, test))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def annotations(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Trimmed annotations with canonical labels; rows with any other label are left out."""
    require_columns(df, ("id", "text", "annotator", "label"))
    return (df.withColumn("label", annotation_label(F.col("label").cast("string")))
            .where(F.col("label").isin(list(labels)))
            .select(_text("id"), _text("text"), _text("annotator"), "label",
                    *[c for c in ("lang", "seq") if c in df.columns]))


def group_map(df: DataFrame, group: str = "group") -> DataFrame:
    """id to group; blank ids are left out, the last row of an id wins."""
    require_columns(df, ("id", group, "seq"))
    rows = df.where(~is_blank("id")).select(_text("id"), strip(group).alias("group"), "seq")
    return rows.groupBy("id").agg(F.max_by("group", "seq").alias("group"))


def final_dataset(df: DataFrame) -> DataFrame:
    """Rows with an id and a label; an input without any is an error."""
    rows = labelled(df).where(~is_blank("id") & ~is_blank("label"))
    if rows.isEmpty():
        raise ValueError("no usable rows in the dataset")
    return rows


def predictions(df: DataFrame) -> DataFrame:
    """id, label, pred_label under any letter case."""
    named = rename_case_insensitive(df, ("id", "label", "pred_label"))
    return named.select("id", F.upper("label").alias("label"), F.upper("pred_label").alias("pred_label"))


def errors(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    require_columns(df, ("id", "text", "label", "pred_label"))
    return fill_uncertainty(df, labels)


def categorised(df: DataFrame, category: str = "category") -> DataFrame:
    """Rows for a stress test; without a category column all rows are 'overall'."""
    require_columns(df, ("id", "text", "label"))
    value = F.coalesce(blank_to_null(category), F.lit("overall")) if category in df.columns else F.lit("overall")
    return df.select("id", "text", upper_label("label").alias("label"), value.alias("category"))


def inference(df: DataFrame) -> DataFrame:
    """Rows to score: id and text, the label upper-cased when there is one, other columns untouched."""
    require_columns(df, ("id", "text"))
    return df.withColumn("label", upper_label("label")) if "label" in df.columns else df


def corpus_from_table(df: DataFrame, text: str = "text") -> DataFrame:
    require_columns(df, (text,))
    return df.select(F.col(text).cast("string").alias("text"), *[c for c in ("id", "seq") if c in df.columns])


def corpus_from_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per line of text files."""
    place = row_place(0, F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return spark.read.text(paths).select(F.col("value").alias("text"), place.alias("seq"))


def combine(*parts: DataFrame) -> DataFrame:
    """All rows of all sources, copies included. Sources keep their order when read with rising ``source_no``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
