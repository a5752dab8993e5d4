"""Writers. Each takes a table, writes a folder, and returns nothing."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.labels import file_safe, upper_label
from labelweave.functions.proba import proba_to_columns
from labelweave.operators.review import review_columns
from labelweave.schema import LABELS

QUEUE_COLUMNS = ("id", "text", "annotator_a", "label_a", "annotator_b", "label_b")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).partitionBy(*partition)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(path)


def final_columns(df: DataFrame) -> DataFrame:
    """id, text, label, and group only when some row has one."""
    has_group = "group" in df.columns and not df.where("group is not null and group <> ''").isEmpty()
    return df.select("id", "text", "label", *(["group"] if has_group else []))


def write_final(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(final_columns(df), path, fmt)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split, so a reader of one split touches nothing else."""
    write_table(df, path, fmt, partition=["split"])


def clean_copy(df: DataFrame) -> DataFrame:
    return df.withColumn("label", upper_label("label"))


def write_clean_copy(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(clean_copy(df).drop("seq"), path, fmt)


def prediction_columns(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """id, text, [label], pred_label and one probability column per label, addressed by name."""
    extra = [c for c in ("pred_set", "set_size") if c in df.columns]
    sets = [F.array_join("pred_set", ",").alias("pred_set") if c == "pred_set" else F.col(c) for c in extra]
    return df.select("id", "text", *(["label"] if "label" in df.columns else []), "pred_label", *sets,
                     *proba_to_columns("proba", labels))


def write_predictions(df: DataFrame, path: str, labels: Sequence[str] = LABELS, fmt: str = "parquet") -> None:
    write_table(prediction_columns(df, labels), path, fmt)


def write_queue(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(df.select(*QUEUE_COLUMNS), path, fmt)


def write_review(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(review_columns(df), path, fmt)


def write_misclassified(df: DataFrame, path: str, category: str = "category", fmt: str = "parquet") -> None:
    """One folder per category, named with file-safe characters."""
    wrong = df.where(F.col("label") != F.col("pred_label"))
    write_table(wrong.withColumn("category", file_safe(F.col(category).cast("string"))), path, fmt, ["category"])


def write_small(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Tables whose size does not depend on the data (bins, confusion, reports) as a single file."""
    write_table(df.coalesce(1), path, fmt)


def metrics_document(**parts: DataFrame | dict) -> Column:
    """Nested JSON text; tables must have one row each."""
    fields = []
    for name, part in parts.items():
        if isinstance(part, dict):
            fields.append(F.parse_json(F.lit(json.dumps(part))).alias(name))
        else:
            fields.append(F.struct(*[part.select(c).scalar().alias(c) for c in part.columns]).alias(name))
    return F.to_json(F.struct(*fields))


def write_metrics(spark: SparkSession, path: str, **parts) -> None:
    """One metrics.json-shaped document in the folder."""
    spark.range(1).select(metrics_document(**parts).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(path: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        write_table(table, f"{path}/{name}")


def record_run(spark: SparkSession, path: str, run: str, params: dict, metrics: dict, tags: dict | None = None) -> None:
    """Append a run to the params, metrics and tags tables."""
    texts = "run string, name string, value string"
    for table, pairs in (("params", params), ("tags", tags or {})):
        rows = [(run, k, str(v)) for k, v in pairs.items()]
        spark.createDataFrame(rows, texts).coalesce(1).write.mode("append").parquet(f"{path}/{table}")
    numbers = [(run, k, float(v)) for k, v in metrics.items() if v is not None]
    spark.createDataFrame(numbers, "run string, name string, value double").coalesce(1).write.mode("append").parquet(
        f"{path}/metrics")
