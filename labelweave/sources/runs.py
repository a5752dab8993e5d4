"""Metrics documents of training runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.labels import number


METRICS = r"metrics\.json(?:/part-[^/]*)?"


def read_runs(spark: SparkSession, paths: Sequence[str], pattern: str = METRICS) -> DataFrame:
    """(model, doc, place) for every readable metrics document at or below the paths; ``model`` is its folder.

    Paths are documents, folders, or globs of either. A document is a file ``metrics.json``, or a folder of that name as
    the writer leaves it. Each counts once; ``place`` orders documents by the path that names them first, then by name.
    Unreadable documents have no row.
    """
    found = None
    for place, given in enumerate(dict.fromkeys(p.rstrip("/") for p in paths)):
        files = (spark.read.option("recursiveFileLookup", True).text(given, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("file").rlike(f"/{pattern}$")))
        rows = files.select("file", F.lit(place).alias("at"), F.try_parse_json("value").alias("doc"))
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        return spark.createDataFrame([], "model string, place struct<at: int, file: string>").select("model", F.parse_json(F.lit("{}")).alias("doc"), "place")
    once = found.where("doc is not null").groupBy("file").agg(F.min("at").alias("at"), F.any_value("doc").alias("doc"))
    return once.select(F.regexp_replace("file", f"/{pattern}$", "").alias("model"), "doc", F.struct("at", "file").alias("place"))


def _at(path: str) -> Column:
    return number(F.try_variant_get("doc", f"$.{path}", "string"))


def _either(*paths: str) -> Column:
    return F.coalesce(*[_at(p) for p in paths])


def overall(runs: DataFrame) -> DataFrame:
    """One row of headline numbers per run, under either spelling of a key; absent values are null."""
    cols = [F.col("model")]
    for split in ("val", "test"):
        for metric in ("accuracy", "f1_macro"):
            cols.append(_either(f"{split}.eval_{metric}", f"{split}.{metric}").alias(f"{split}_{metric}"))
    for split in ("val", "test"):
        for metric in ("ece", "brier"):
            cols.append(_either(f"calibration.{split}.{metric}", f"{split}_{metric}").alias(f"{split}_{metric}"))
    for name in ("train_seconds", "test_eval_seconds", "test_throughput_examples_per_sec"):
        cols.append(_at(f"timing.{name}").alias(name))
    cols += [_at("model_params.total").alias("params_total"), _at("model_params.trainable").alias("params_trainable")]
    return runs.select(*cols)


def comparison(runs: DataFrame) -> DataFrame:
    """Scores to six places, split sizes and calibration method per run."""
    scores = [F.round(_at(f"{s}.{m}"), 6).alias(f"{s}_{m}") for s in ("val", "test") for m in ("accuracy", "f1_macro")]
    sizes = [F.try_variant_get("doc", f"$.sizes.{s}", "long").alias(f"n_{s}") for s in ("train", "val", "test")]
    method = F.coalesce(F.try_variant_get("doc", "$.params.calibrate", "string"), F.lit("none"))
    return runs.select("model", *scores, *sizes, method.alias("calibrate"))


def per_language(runs: DataFrame) -> DataFrame:
    """(model, split, lang, metric, value) from keys like accuracy__km."""
    parts = []
    for split in ("val", "test"):
        entries = F.explode(F.try_variant_get("doc", f"$.per_language.{split}", "map<string,variant>")).alias("key", "v")
        parts.append(runs.select("model", F.lit(split).alias("split"), entries))
    rows = parts[0].unionByName(parts[1])
    metric, lang = F.split_part("key", F.lit("__"), F.lit(1)), F.regexp_extract("key", "^[a-z0-9_]+?__(.*)$", 1)
    return rows.where(metric.isin("accuracy", "f1_macro")).select(
        "model", "split", lang.alias("lang"), metric.alias("metric"),
        number(F.try_variant_get("v", "$", "string")).alias("value"))


def calibration(runs: DataFrame) -> DataFrame:
    """(model, split, ece, brier, n_samples, n_classes) for splits that report calibration."""
    parts = [F.struct(
        F.lit(s).alias("split"), _at(f"calibration.{s}.ece").alias("ece"), _at(f"calibration.{s}.brier").alias("brier"),
        F.try_variant_get("doc", f"$.calibration.{s}.n_samples", "long").alias("n_samples"),
        F.try_variant_get("doc", f"$.calibration.{s}.n_classes", "long").alias("n_classes")) for s in ("val", "test")]
    return runs.select("model", F.inline(F.array(*parts))).where("ece is not null or brier is not null")


def model_listing(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """(model, type, has_metrics, test_accuracy, test_f1_macro) for folders below ``root`` that hold a model.

    A folder is a linear model when it holds features and weights, and a plug-in model when it holds a config.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    marks = files.select(
        F.regexp_extract("path", rf"^(.*?/{_tail(root)}/[^/]+)/", 1).alias("model"),
        F.regexp_extract("path", rf"/{_tail(root)}/[^/]+/([^/]+)", 1).alias("entry"))
    has = marks.groupBy("model").agg(*[F.max((F.col("entry") == e).cast("int")).alias(f"_{i}") for i, e in enumerate(
        ("features", "model", "config.json", "metrics.json"))])
    kind = F.when((F.col("_0") == 1) & (F.col("_1") == 1), "linear").when(F.col("_2") == 1, "plugin")
    listed = has.where("model <> ''").select("model", kind.alias("type"), (F.col("_3") == 1).alias("has_metrics")).where(
        "type is not null")
    scores = overall(runs).select("model", "test_accuracy", "test_f1_macro")
    return listed.join(scores, "model", "left")


def _tail(root: str) -> str:
    return re.escape(root.rstrip("/").rsplit("/", 1)[-1])


def top_runs(rows: DataFrame, k: int = 10) -> DataFrame:
    """Best runs by test macro-F1; runs without one come last."""
    return rows.orderBy(F.col("test_f1_macro").desc_nulls_last(), "model").limit(k)


def read_report(spark: SparkSession, folder: str, names: tuple[str, ...] = ("overall", "per_language", "calibration")) -> dict[str, DataFrame]:
    """The report tables written by the report sink; ``stress_deltas`` is there when the report was given one."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
