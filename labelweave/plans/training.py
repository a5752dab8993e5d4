"""Split, repair, normalise, resample, fit, calibrate, evaluate, record."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.operators import calibration as C
from labelweave.operators import metrics as M
from labelweave.operators import models
from labelweave.operators import sampling as S
from labelweave.operators.compare import combo_name, parameter_grid
from labelweave.operators.models import TextClassifier, TrainConfig
from labelweave.session import passing
from labelweave.sinks import tables as sinks

SPLITTERS = {
    "stratified": lambda df, r, seed: S.stratified_split(df, *r, seed=seed),
    "stratified_lang": lambda df, r, seed: S.stratified_split(df, *r, seed=seed, by_lang=True),
    "group": lambda df, r, seed: S.group_split_or_stratified(df, *r, seed=seed),
    "group_stratified": lambda df, r, seed: S.group_stratified_split(df, *r, seed=seed),
}


@dataclass
class TrainingResult:
    classifier: TextClassifier
    predictions: DataFrame
    scores: DataFrame
    sizes: dict
    train_seconds: float


def resampler(cfg: TrainConfig):
    if cfg.resample == "none":
        return None
    how = {"oversample": S.oversample, "undersample": S.undersample}[cfg.resample]
    return lambda rows: how(rows, cfg.resample_ratio, cfg.seed)


def train_and_evaluate(df: DataFrame, cfg: TrainConfig = TrainConfig(), splitter: str | None = "stratified",
                       ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> TrainingResult:
    """Train on the train split and score val and test; ``splitter=None`` keeps the ``split`` column of the input.

    The scored rows are computed once and feed every metric.
    """
    started = time.time()
    rows = SPLITTERS[splitter](df, ratios, cfg.seed) if splitter else df
    rows = S.repair_splits(rows, cfg.seed)
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    part = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    classifier = models.fit(part["train"], cfg, part["val"], resampler(cfg))
    seconds = time.time() - started
    scored = classifier.score(rows.where("split <> 'train'")).persist()
    scores = M.summary(M.count_table(scored, ["split"]), ["split"])
    return TrainingResult(classifier, scored, scores, sizes, seconds)


def evaluation_tables(result: TrainingResult) -> dict[str, DataFrame]:
    counts = M.count_table(result.predictions, ["split"]).persist()
    labels = result.classifier.classes
    return {
        "scores": result.scores,
        "report": M.report(counts, ["split"]),
        "confusion": M.confusion(counts, labels, ["split"]),
        "calibration": C.calibration_summary(result.predictions, by=["split"], labels=labels),
        "calibration_by_lang": C.calibration_summary(result.predictions, 10, by=["split", "lang"], labels=labels)
        if "lang" in result.predictions.columns else None,
    }


def save_run(result: TrainingResult, folder: str, run: str, params: dict) -> None:
    """Model, evaluation tables, metrics document and run record."""
    spark = result.predictions.sparkSession
    result.classifier.save(f"{folder}/{run}")
    for name, table in evaluation_tables(result).items():
        if table is not None:
            sinks.write_small(table, f"{folder}/{run}/{name}", "parquet")
    scores = {r["split"]: r.asDict() for r in result.scores.collect()}
    plain = {s: {k: v for k, v in d.items() if k != "split"} for s, d in scores.items()}
    sinks.write_metrics(spark, f"{folder}/{run}/metrics.json", **plain, sizes=result.sizes,
                        params={k: str(v) for k, v in params.items()}, timing={"train_seconds": result.train_seconds})
    flat = {f"{s}_{m}": d[m] for s, d in plain.items() for m in ("accuracy", "f1_macro")}
    sinks.record_run(spark, f"{folder}/runs", run, params, flat, {"classes": ",".join(result.classifier.classes)})


def sweep(df: DataFrame, base: TrainConfig, grid: dict, splitter: str | None = "stratified",
          ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(run, status, split, n, accuracy, f1_macro) for every combination; a failing one is reported and skipped.

    The rows are split once for all combinations. What a combination writes leaves the disk before the next one begins.
    """
    from dataclasses import replace
    spark = df.sparkSession
    rows = (SPLITTERS[splitter](df, ratios, base.seed) if splitter else df).persist()

    def scores(combo: dict) -> list[tuple]:
        norm = {k[5:]: v for k, v in combo.items() if k.startswith("norm_")}
        cfg = replace(base, norm=base.norm.override(**norm),
                      **{k: v for k, v in combo.items() if not k.startswith("norm_")})
        result = train_and_evaluate(rows, cfg, splitter=None)
        found = [(combo_name(combo), "ok", r["split"], r["n"], r["accuracy"], r["f1_macro"]) for r in result.scores.collect()]
        result.predictions.unpersist()
        return found

    out = []
    for combo in parameter_grid(grid):
        try:
            with passing(spark, "combination"):  # vectors are larger than the texts
                out += scores(combo)
        except (ValueError, TypeError) as ex:
            out.append((combo_name(combo), f"failed: {ex}", None, None, None, None))
    rows.unpersist()
    return spark.createDataFrame(out, "run string, status string, split string, n long, accuracy double, f1_macro double")
