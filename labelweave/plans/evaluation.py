"""From a model and labelled rows to everything one wants to know about its errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions import labels as L
from labelweave.functions import perturb as T
from labelweave.functions import proba as P
from labelweave.functions.normalize import normalize
from labelweave.operators import calibration as C
from labelweave.operators import conformal as X
from labelweave.operators import explain as E
from labelweave.operators import metrics as M
from labelweave.operators import review as R
from labelweave.operators import sampling as S
from labelweave.operators.agreement import queue_new
from labelweave.operators.models import TextClassifier
from labelweave.schema import LABELS


def analyse_errors(scored: DataFrame, labels: Sequence[str] = LABELS, slice_column: str | None = None,
                   n_bins: int = 15) -> dict[str, DataFrame]:
    """Tables of an error analysis from one persisted prediction table."""
    scored = scored.persist()
    counts = M.count_table(scored).persist()
    bins = C.reliability_bins(scored, n_bins, empty="midpoint")
    points = C.pr_points(scored, labels).persist()
    out = {
        "misclassified": R.misclassified(scored), "scores": M.summary(counts), "report": M.report(counts),
        "confusion": M.confusion(counts, labels), "bins": bins, "calibration_error": C.calibration_error(bins),
        "pr_curve": C.pr_curve(points), "average_precision": C.average_precision(points),
        "thresholds": C.best_thresholds(points),
    }
    if slice_column:
        out["slices"] = M.per_slice(scored, slice_column)
    return out


def request_records(df: DataFrame, classifier: TextClassifier, tau: float = X.DEFAULT_TAU, top_k: int = 3,
                    importance: int = 0, max_chars: int | None = None) -> DataFrame:
    """Everything a caller gets for one text: normalised text, probabilities, label, set, uncertainty, top classes,
    and with ``importance`` the n-grams that carried the prediction.

    With ``max_chars`` texts that may not be scored are returned too, with their ``reason`` and nothing else.
    """
    if max_chars is not None:
        accepted, rejected = accepted_and_rejected(df, max_chars)
        answered = request_records(accepted, classifier, tau, top_k, importance).withColumn("reason", F.lit(None).cast("string"))
        return answered.unionByName(rejected, allowMissingColumns=True)
    scored = X.prediction_sets(classifier.score(df), tau, sorted(classifier.classes))
    out = scored.withColumns({"entropy": P.entropy("proba"), "max_proba": P.confidence("proba"),
                              "top": P.top_classes("proba", top_k), "tau": F.lit(float(tau))})
    if importance > 0:
        out = E.importance_of_prediction(out, classifier, *E.ngram_range(classifier), k=importance)
    return out


def accepted_and_rejected(df: DataFrame, max_chars: int = L.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Rows that may be scored, and the others with their reason."""
    marked = df.withColumn("reason", L.rejection_reason("text", max_chars))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def conformal_predictions(df: DataFrame, classifier: TextClassifier, coverage: float = 0.9, share: float = 0.2,
                          seed: int = 42, calibration: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Prediction sets on the rows not used for calibration, their coverage, and tau."""
    labels = sorted(classifier.classes)
    if calibration is not None:
        calib, rest = classifier.score(calibration), classifier.score(df)
    else:
        parts = classifier.score(S.hold_out(df, share, seed)).persist()
        calib, rest = parts.where("held_out"), parts.where("NOT held_out")
    tau = X.fit_tau(calib, rest, coverage, labels=labels)
    sets = X.prediction_sets(rest, tau, labels)
    return sets, X.coverage(sets), tau


def stress_test(df: DataFrame, classifier: TextClassifier, preset: str, severity: float = 0.5, prob: float = 1.0,
                seed: int = 42, category: str = "category") -> tuple[DataFrame, DataFrame]:
    """Scores on perturbed texts, overall and per category, and the scored rows.

    Texts are normalised first and perturbed afterwards, so the model sees the perturbation as it is.
    """
    plain = TextClassifier(classifier.features, classifier.model, classifier.classes, calibrators=classifier.calibrators)
    noisy = df.withColumn("text", T.perturb(preset, normalize("text", classifier.norm), "id", severity, prob, seed))
    scored = plain.score(noisy)
    return M.overall_and_per_category(scored, category), scored


def error_loop(scored: DataFrame, logged: DataFrame | None = None, strategy: str = "uncertain", limit: int = 0,
               seed: int = 42) -> DataFrame:
    """Wrong rows that are not in the log yet, in review order, with the note to append."""
    wrong = scored.where(F.col("label") != F.col("pred_label"))
    if logged is not None:
        wrong = queue_new(wrong, logged)
    queue = R.review_columns(R.review_queue(wrong, strategy, limit, seed))
    return queue.withColumn("note", L.review_note(F.col("id").cast("string"), "text", "gold_label", "model_label"))
