"""Text classifiers on Spark ML: n-gram features, multinomial logistic regression, calibration, scoring."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from labelweave.functions import proba as P
from labelweave.functions.normalize import NormConfig, normalize
from labelweave.operators import calibration as C
from labelweave.operators import features
from labelweave.operators import metrics as M
from labelweave.operators.features import GramFeatures
from labelweave.schema import LABELS, keyed_hash, spread


@dataclass(frozen=True)
class TrainConfig:
    ngram_min: int = 3
    ngram_max: int = 5
    min_df: int = 2
    max_iter: int = 200
    c: float = 1.0
    class_weight: str | dict = "none"
    calibrate: str = "none"
    folds: int = 0
    resample: str = "none"
    resample_ratio: float = 1.0
    seed: int = 42
    features: str = "vocabulary"
    num_features: int = 1 << 18
    norm: NormConfig = field(default_factory=NormConfig)


def fit_features(train: DataFrame, cfg: TrainConfig, text: str = "_norm") -> GramFeatures:
    """Features of a configuration; see ``features.fit_features``."""
    return features.fit_features(train, cfg.ngram_min, cfg.ngram_max, cfg.min_df, cfg.features, cfg.num_features, text)


def row_weights(train: DataFrame, class_weight: str | dict, label: str = "label") -> Column:
    """none, balanced, or a label-to-weight map."""
    if class_weight == "none":
        return F.lit(1.0)
    if class_weight == "balanced":
        counts = {r["label"]: r["n"] for r in M.distribution(train, label).collect()}
        total = sum(counts.values())
        return M.weight_of(label, {l: total / (len(counts) * n) for l, n in counts.items()})
    return M.weight_of(label, dict(class_weight))


def fit_classifier(rows: DataFrame, cfg: TrainConfig, label: str = "label") -> tuple[LogisticRegressionModel, list[str]]:
    """Multinomial logistic regression with an L2 penalty on the sum of losses; classes in name order."""
    classes = [r[label] for r in rows.select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("need at least two classes to train")
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    ready = rows.select("features", index.cast("double").alias("_y"), row_weights(rows, cfg.class_weight, label).alias("_w"))
    mass = ready.agg(F.sum("_w").alias("w")).first()["w"]
    learner = LogisticRegression(family="multinomial", featuresCol="features", labelCol="_y", weightCol="_w",
                                 maxIter=cfg.max_iter, tol=1e-4, regParam=1.0 / (cfg.c * mass), standardization=False)
    return learner.fit(ready), classes


@dataclass
class Calibrator:
    """Per class a map from the class score to a probability, renormalised over the classes."""

    method: str
    temperature: float = 1.0
    lines: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, classes: Sequence[str], logits: str = "logits", proba: str = "proba") -> DataFrame:
        """Adds or replaces the ``proba`` map from the ``logits`` map."""
        if self.method == "temperature":
            return df.withColumn(proba, P.softmax(logits, self.temperature))
        if self.method == "platt":
            parts = {l: 1 / (1 + F.exp(-(F.element_at(logits, F.lit(l)) * a + b))) for l, (a, b) in self.lines.items()}
            df = df.withColumns({f"_c{i}": parts[l] for i, l in enumerate(classes)})
        else:
            for i, l in enumerate(classes):
                df = df.withColumn("_s", F.element_at(logits, F.lit(l)))
                df = self.steps[l].setPredictionCol(f"_c{i}").transform(df).drop("_s")
        total = sum(F.col(f"_c{i}") for i in range(len(classes)))
        fair = F.lit(1.0 / len(classes))
        shares = [x for i, l in enumerate(classes)
                  for x in (F.lit(l), F.when(total > 0, F.col(f"_c{i}") / total).otherwise(fair))]
        return df.withColumn(proba, F.create_map(*shares)).drop(*[f"_c{i}" for i in range(len(classes))])


def fit_calibrator(scored: DataFrame, method: str, classes: Sequence[str], label: str = "label") -> Calibrator:
    """From rows with ``logits`` and gold labels."""
    if method == "temperature":
        return Calibrator("temperature", C.fit_temperature(scored, classes, label))
    if method not in ("platt", "isotonic"):
        raise ValueError(f"unknown calibration {method!r}")
    out = Calibrator(method)
    for l in classes:
        one = scored.select(F.element_at("logits", F.lit(l)).alias("_s"), (F.col(label) == l).cast("double").alias("_y"))
        if method == "platt":
            points = VectorAssembler(inputCols=["_s"], outputCol="_x").transform(one)
            fit = LogisticRegression(featuresCol="_x", labelCol="_y", family="binomial").fit(points)
            out.lines[l] = (float(fit.coefficients[0]), float(fit.intercept))
        else:
            out.steps[l] = IsotonicRegression(featuresCol="_s", labelCol="_y").fit(one)
    return out


@dataclass
class TextClassifier:
    """Normaliser, features, linear model, optional calibration: everything scoring needs."""

    features: GramFeatures
    model: LogisticRegressionModel
    classes: list[str]
    norm: NormConfig = field(default_factory=NormConfig)
    calibrators: list = field(default_factory=list)

    def vectorize(self, df: DataFrame, text: str = "text") -> DataFrame:
        return self.features.transform(df.withColumn("_norm", normalize(text, self.norm)))

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds normalized_text, logits and proba (maps by label), pred_label, confidence and margin."""
        if self.features.counted:
            heads = [self.model, *[m for m, _ in self.calibrators if m is not None]]
            rows = scored_by(self.features, df.withColumn("_norm", normalize(text, self.norm)), heads)
        else:
            rows = self.vectorize(df, text)
        return add_prediction(self._probabilities(rows)).withColumnRenamed("_norm", "normalized_text")

    def _head(self, model: LogisticRegressionModel, rows: DataFrame, logits: str, proba: str, at: int) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.classes])
        if "features" not in rows.columns:
            return rows.withColumns({logits: F.map_from_arrays(names, f"_l{at}"), proba: F.map_from_arrays(names, f"_p{at}")})
        return model.transform(rows).withColumns({
            logits: F.map_from_arrays(names, vector_to_array("rawPrediction")),
            proba: F.map_from_arrays(names, vector_to_array("probability")),
        }).drop("rawPrediction", "probability", "prediction")

    def _probabilities(self, rows: DataFrame) -> DataFrame:
        """Every head and calibrator runs over the same rows, one after the other; nothing is joined. Rows without vectors bring the
        scores of all heads."""
        scored = self._head(self.model, rows, "logits", "proba", 0)
        if len(self.calibrators) == 1 and self.calibrators[0][0] is None:
            scored = self.calibrators[0][1].apply(scored, self.classes)
        elif self.calibrators:
            for i, (member, calibrator) in enumerate(self.calibrators):
                scored = calibrator.apply(self._head(member, scored, f"_ml{i}", f"_mp{i}", i + 1), self.classes, f"_ml{i}", f"_mp{i}")
            mean = F.create_map(*[x for l in self.classes for x in (F.lit(l), sum(
                F.element_at(f"_mp{i}", F.lit(l)) for i in range(len(self.calibrators))) / len(self.calibrators))])
            scored = scored.withColumn("proba", mean).drop(*[f"_m{c}{i}" for i in range(len(self.calibrators)) for c in "lp"])
        return scored.drop("features", *[f"_{c}{i}" for i in range(len(self.calibrators) + 1) for c in "lp"])

    def vocabulary(self) -> list[str]:
        """All n-grams in the order of their columns. A list for small models; ``features.index`` is the table."""
        return [r["gram"] for r in self.features.index.orderBy("column", "gram").collect()]

    def weights(self, spark) -> DataFrame:
        """(feature, idf, label, weight, column) rows, one per n-gram and class; n-grams of one hashed column share its weight."""
        table = self.features.index.join(features.coefficient_table(spark, self.model.coefficientMatrix.toArray()), "column")
        return table.select(F.col("gram").alias("feature"), "idf", F.inline(F.array(*[
            F.struct(F.lit(c).alias("label"), F.col("w")[i].alias("weight")) for i, c in enumerate(self.classes)])), "column")

    def save(self, path: str) -> None:
        spark = _active_session()
        self.features.save(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"classes": self.classes, "norm": asdict(self.norm), "calibrators": []}
        for i, (member, cal) in enumerate(self.calibrators):
            if member is not None:
                member.write().overwrite().save(f"{path}/member_{i}")
            for j, c in enumerate(self.classes):
                if c in cal.steps:
                    cal.steps[c].write().overwrite().save(f"{path}/steps_{i}_{j}")
            meta["calibrators"].append({"own": member is not None, "method": cal.method,
                                        "temperature": cal.temperature, "lines": cal.lines})
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "TextClassifier":
        spark = _active_session()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        calibrators = []
        for i, c in enumerate(meta["calibrators"]):
            steps = {}
            if c["method"] == "isotonic":
                steps = {l: IsotonicRegressionModel.load(f"{path}/steps_{i}_{j}") for j, l in enumerate(meta["classes"])}
            member = LogisticRegressionModel.load(f"{path}/member_{i}") if c["own"] else None
            lines = {k: tuple(v) for k, v in c["lines"].items()}
            calibrators.append((member, Calibrator(c["method"], c["temperature"], lines, steps)))
        return cls(GramFeatures.load(f"{path}/features"), LogisticRegressionModel.load(f"{path}/model"),
                   meta["classes"], NormConfig(**meta["norm"]), calibrators)


def _active_session():
    from pyspark.sql import SparkSession
    return SparkSession.active()


def scored_by(fitted: GramFeatures, rows: DataFrame, heads: Sequence[LogisticRegressionModel]) -> DataFrame:
    """The rows with the scores of each head."""
    return fitted.scores(rows, [(m.coefficientMatrix.toArray(), m.interceptVector.toArray()) for m in heads])


def add_prediction(df: DataFrame) -> DataFrame:
    return df.withColumns({"pred_label": P.argmax_label("proba"), "confidence": P.confidence("proba"),
                           "margin": P.margin("proba")})


def fit(train: DataFrame, cfg: TrainConfig = TrainConfig(), val: DataFrame | None = None,
        resampler: Callable[[DataFrame], DataFrame] | None = None) -> TextClassifier:
    """Train on (id, text, label); calibrate on ``val``, or over folds of ``train`` when cfg.folds > 1."""
    rows = (spread(train.select("id", "label", "text"), "id")
            .withColumn("_norm", normalize("text", cfg.norm)).drop("text").persist())
    fitted = fit_features(rows, cfg)
    vectors = _vectors(fitted, rows, "id", "label")
    sample = resampler(vectors) if resampler else vectors
    model, classes = fit_classifier(sample, cfg)
    out = TextClassifier(fitted, model, classes, cfg.norm)
    if cfg.calibrate != "none":
        if cfg.folds > 1 and cfg.calibrate != "temperature":
            out.calibrators = [_fold(vectors, out, cfg, k) for k in range(cfg.folds)]
        else:
            if val is None or val.isEmpty():
                raise ValueError("calibration needs validation rows")
            scored = out._probabilities(out.vectorize(val).select("id", "label", "features"))
            scored = scored.persist()
            out.calibrators = [(None, fit_calibrator(scored, cfg.calibrate, classes))]
            scored.unpersist()
    vectors.unpersist()
    rows.unpersist()
    return out


def _vectors(fitted: GramFeatures, rows: DataFrame, *keep: str) -> DataFrame:
    """Vectors that are read many times; those written already need no second copy."""
    made = fitted.transform(rows, keep)
    return made if fitted.counted else made.persist()


def _fold(vectors: DataFrame, whole: TextClassifier, cfg: TrainConfig, k: int):
    """Model of all folds but one, calibrated on that one; folds are drawn by key."""
    fold = F.conv(F.substring(keyed_hash(cfg.seed, "id", F.lit("fold")), 1, 8), 16, 10).cast("long") % cfg.folds
    member, classes = fit_classifier(vectors.where(fold != k), cfg)
    if classes != whole.classes:
        raise ValueError("a fold misses a class")
    part = TextClassifier(whole.features, member, classes)
    scored = part._probabilities(vectors.where(fold == k)).persist()
    fitted = fit_calibrator(scored, cfg.calibrate, classes)
    scored.unpersist()
    return member, fitted


def with_weights(fitted: GramFeatures, classes: Sequence[str], weights: DataFrame, intercepts: dict[str, float] | None = None,
                 norm: NormConfig | None = None) -> TextClassifier:
    """A classifier of given weights (feature, label, weight), for linear models that were fitted elsewhere.

    N-grams without a weight, and weights of n-grams outside the index, count as nothing. The driver holds the coefficient
    matrix, as it does for any fitted model.
    """
    spark = weights.sparkSession
    matrix = np.zeros((len(classes), fitted.size))
    found = fitted.index.join(weights, F.col("gram") == F.col("feature")).where(F.col("label").isin(list(classes))).select("column", "label", "weight")
    for batch in found.withColumn("label", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).toArrow().to_batches():
        at, column, weight = (batch.column(c).to_numpy() for c in ("label", "column", "weight"))
        np.add.at(matrix, (at, column), weight)
    offsets = [float((intercepts or {}).get(c, 0.0)) for c in classes]
    made = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"given-{uuid.uuid4().hex}", _py2java(spark.sparkContext, DenseMatrix(*matrix.shape, matrix.ravel(order="F"))),
        _py2java(spark.sparkContext, DenseVector(offsets)), len(classes), True)
    return TextClassifier(fitted, LogisticRegressionModel(made), list(classes), norm or NormConfig())


@dataclass
class LanguageRouted:
    """One linear head per language on shared features, and a default head for every other language."""

    default: TextClassifier
    heads: dict

    def score(self, df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        heads = [("", self.default), *sorted(self.heads.items())]
        fitted, chosen = self.default.features, None
        if fitted.counted:
            routed = scored_by(fitted, df.withColumn("_norm", normalize(text, self.default.norm)), [h.model for _, h in heads])
        else:
            routed = self.default.vectorize(df, text)
        for i, (name, head) in enumerate(heads):
            classes = F.array(*[F.lit(c) for c in head.classes])
            if not fitted.counted:
                routed = head.model.transform(routed).withColumn(f"_p{i}", vector_to_array("probability")).drop(
                    "rawPrediction", "probability", "prediction")
            routed = routed.withColumn(f"_p{i}", F.map_from_arrays(classes, f"_p{i}")).drop(f"_l{i}")
            if name:
                here = F.lower(F.col(lang)) == name
                chosen = F.when(here, F.col(f"_p{i}")) if chosen is None else chosen.when(here, F.col(f"_p{i}"))
        proba = F.col("_p0") if chosen is None else chosen.otherwise(F.col("_p0"))
        out = routed.withColumn("proba", proba).drop("features", *[f"_p{i}" for i in range(len(self.heads) + 1)])
        return add_prediction(out).withColumnRenamed("_norm", "normalized_text")


def fit_language_routed(train: DataFrame, cfg: TrainConfig = TrainConfig(), langs: Sequence[str] | None = None) -> LanguageRouted:
    """Heads for the listed languages, or for those present; a language with a single class uses the default head.

    One model is fitted per language, so a column of codes is meant, not free text.
    """
    lower = F.lower("lang")
    if langs is None:
        langs = sorted(r["l"] for r in train.where("lang is not null").select(lower.alias("l")).distinct().collect())
    rows = spread(train.select("id", "label", lower.alias("_lang"), "text"), "id").withColumn(
        "_norm", normalize("text", cfg.norm)).drop("text").persist()
    fitted = fit_features(rows, cfg)
    vectors = _vectors(fitted, rows, "id", "label", "_lang")
    default = TextClassifier(fitted, *fit_classifier(vectors, cfg), cfg.norm)
    heads = {}
    for l in langs:
        part = vectors.where(F.col("_lang") == l.lower())
        if part.select("label").distinct().limit(2).count() == 2:
            heads[l.lower()] = TextClassifier(fitted, *fit_classifier(part, cfg), cfg.norm)
    vectors.unpersist()
    rows.unpersist()
    return LanguageRouted(default, heads)


def score_with(df: DataFrame, make_predict: Callable, labels: Sequence[str] = LABELS, text: str = "text",
               batch_size: int = 32, logits: bool = True) -> DataFrame:
    """Score with any user model: ``make_predict()`` returns a function from a batch of texts to an (n, k) array.

    The model is built once per Python worker; ``logits`` says whether its output still needs a softmax. The prediction is
    the column with the largest output, the first one on a tie; outputs are compared as they are, since a softmax may make
    two of them equal.
    """
    score = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    names = F.array(*[F.lit(l) for l in labels])
    out = df.withColumn("logits", F.map_from_arrays(names, score(F.col(text))))
    scored = add_prediction(out.withColumn("proba", P.softmax("logits") if logits else F.col("logits")))
    outputs = F.map_values("logits")
    return scored.withColumn("pred_label", F.get(names, F.array_position(outputs, F.array_max(outputs)).cast("int") - 1))
