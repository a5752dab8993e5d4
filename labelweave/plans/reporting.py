"""Comparison of runs, and corpus reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.normalize import NormConfig, normalize_corpus
from labelweave.operators import compare as C
from labelweave.operators import corpus
from labelweave.plans import curation, evaluation, training
from labelweave.sources import runs as R
from labelweave.sinks import tables as sinks


def run_report(runs: DataFrame, pairs: dict[str, tuple[DataFrame, DataFrame]] | None = None,
               stressed: DataFrame | None = None, top_k: int = 10) -> dict[str, DataFrame]:
    """Overall, per-language and calibration tables, the best runs, intervals per pair and robustness deltas."""
    overall = R.overall(runs)
    out = {"overall": overall, "per_language": R.per_language(runs), "calibration": R.calibration(runs),
           "top": R.top_runs(overall, top_k)}
    for name, (a, b) in (pairs or {}).items():
        found = C.paired_bootstrap(a, b).withColumn("pair", F.lit(name))
        out["intervals"] = out["intervals"].unionByName(found) if "intervals" in out else found
    if stressed is not None:
        clean = overall.select("model", F.col("test_accuracy").alias("accuracy"), F.col("test_f1_macro").alias("f1_macro"))
        out["stress_deltas"] = C.robustness_deltas(clean, stressed)
        out["stress_unmatched"] = C.unmatched_models(clean, stressed)
    return out


def corpus_report(df: DataFrame, norm: NormConfig | None, num_merges: int, min_frequency: int = 2) -> DataFrame:
    return corpus.corpus_statistics(normalize_corpus(df, norm), num_merges, min_frequency)


def whole_chain(df: DataFrame, folder: str, cfg: training.TrainConfig, run: str, presets: Sequence[str] = ("mixed_script",),
                severity: float = 0.5, num_merges: int = 8) -> dict[str, DataFrame]:
    """Check and split, train and record, corpus statistics, stress tests."""
    spark: SparkSession = df.sparkSession
    final, issues = curation.ingest(df)
    sinks.write_splits(final.select("id", "text", "label", "split"), f"{folder}/data")
    data = spark.read.parquet(f"{folder}/data")
    result = training.train_and_evaluate(data, cfg, splitter=None)
    training.save_run(result, folder, run, {"ngram_max": cfg.ngram_max, "calibrate": cfg.calibrate})
    out = {"issues": issues, "scores": result.scores,
           "corpus": corpus_report(data.withColumn("seq", F.monotonically_increasing_id()), cfg.norm, num_merges)}
    held_back = data.where("split = 'test'").withColumn("category", F.lit("overall"))
    for preset in presets:
        out[f"stress_{preset}"], _ = evaluation.stress_test(held_back, result.classifier, preset, severity)
    return out
