"""Which n-grams speak for which class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelweave.operators import gram_arrays as A
from labelweave.operators import ngrams as G
from labelweave.operators.models import TextClassifier
from labelweave.schema import VOCABULARY_ROWS


def top_features(weights: DataFrame, k: int = 50) -> DataFrame:
    """The k highest and the k lowest weights of every class, heaviest first."""
    high = W.partitionBy("label").orderBy(F.col("weight").desc(), "feature")
    low = W.partitionBy("label").orderBy(F.col("weight").asc(), "feature")
    ends = (weights.withColumn("_high", F.row_number().over(high)).where(F.col("_high") <= k).drop("_high")
            .unionByName(weights.withColumn("_low", F.row_number().over(low)).where(F.col("_low") <= k).drop("_low")))
    return ends.select("label", "feature", F.round("weight", 6).alias("weight")).distinct()


def contributions(texts: DataFrame, weights: DataFrame, nmin: int, nmax: int, key: str = "id",
                  text: str = "text") -> DataFrame:
    """(id, feature, label, contribution): unit-length TF-IDF value times class weight, zeros left out.

    N-grams that share a hashed column form one value of the norm; each brings its own part of it.
    """
    at = "column" if "column" in weights.columns else "feature"
    table = weights.groupBy(F.col("feature").alias("gram"), F.col(at).cast("string").alias("_at"), "idf").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_w"))
    raw = (G.term_counts(texts, nmin, nmax, key, text).join(table, "gram")
           .select(key, "gram", "_at", "_w", (F.col("tf") * F.col("idf")).alias("_raw")))
    value = F.sum("_raw").over(W.partitionBy(key, "_at"))
    first = F.row_number().over(W.partitionBy(key, "_at").orderBy("gram")) == 1
    parts = raw.withColumn("_value", F.when(first, value)).withColumn(
        "_norm", F.sqrt(F.sum(F.col("_value") * F.col("_value")).over(W.partitionBy(key))))
    return (parts.select(key, F.col("gram").alias("feature"), (F.col("_raw") / F.col("_norm")).alias("_x"), F.explode("_w").alias("label", "_weight"))
            .select(key, "feature", "label", (F.col("_x") * F.col("_weight")).alias("contribution"))
            .where("contribution <> 0"))


def _row_key() -> Column:
    """Rows with one id and different texts are explained apart."""
    return F.sha2(F.concat_ws("\x00", F.col("id").cast("string"), F.coalesce("normalized_text", F.lit(""))), 256)


def top_contributions(parts: DataFrame, k: int = 5, by_size: bool = False, key: str = "id") -> DataFrame:
    """(id, label, importance): the k largest contributions per row and class as an array of (feature, weight)."""
    size = F.abs("contribution") if by_size else F.col("contribution")
    order = W.partitionBy(key, "label").orderBy(size.desc(), "feature")
    ranked = parts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(1, k))
    entry = F.struct("_rank", "feature", F.col("contribution").alias("weight"))
    return ranked.groupBy(key, "label").agg(F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(e["feature"].alias("feature"), e["weight"].alias("weight"))).alias("importance"))


def _joined(importance: Column) -> Column:
    return F.array_join(F.transform(importance, lambda e: F.concat_ws(
        "|", e["feature"], F.format_number(e["weight"], 4))), "; ")


_ENTRIES = "array<struct<feature:string,weight:double>>"


def strongest_ngrams(weights: DataFrame, nmin: int, nmax: int, k: int, by_size: bool = False, held: int = VOCABULARY_ROWS):
    """A column function (text, label, ...) -> struct of one array of (feature, weight) for each label: the k largest
    contributions of the text to the class, or null without any. Tasks look texts up in a copy of the weights; None, if
    these are more than ``held`` rows.
    """
    if weights.limit(held + 1).count() > held:
        return None
    at = "column" if "column" in weights.columns else "feature"
    table = (weights.groupBy("feature", F.col(at).cast("string").alias("_at"), "idf")
             .agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_w")).orderBy("feature"))
    classes = sorted(r["label"] for r in weights.select("label").distinct().collect())
    rows = table.select("feature", "_at", "idf", *[F.coalesce(F.element_at("_w", F.lit(c)), F.lit(0.0)).alias(f"_w{i}") for i, c in enumerate(classes)]).toArrow()
    column = np.unique(rows.column("_at").to_numpy(), return_inverse=True)[1] if at == "column" else np.arange(len(rows))
    copy = weights.sparkSession.sparkContext.broadcast((
        rows.column("feature").combine_chunks().cast(pa.string()), A.Held(rows.column("feature").combine_chunks().cast(pa.string())), column, rows.column("idf").to_numpy(),
        {c: rows.column(f"_w{i}").to_numpy() for i, c in enumerate(classes)}))
    k = max(1, k)

    def for_label(labels: pa.Array, of, place, x) -> pa.Array:
        grams, _, _, _, weight_of = copy.value
        parts = []
        for c, w in weight_of.items():
            mine = pc.fill_null(pc.equal(labels, c), False).to_numpy(zero_copy_only=False)[of]
            part = x[mine] * w[place[mine]]
            some = part != 0
            o, p, part = of[mine][some], place[mine][some], part[some]
            kept = A.strongest(o, p, np.abs(part) if by_size else part, np.arange(len(grams)), k)  # the copy is in the order of n-grams
            parts.append((o[kept], p[kept], part[kept]))
        o, p, part = (np.concatenate(c) for c in zip(*parts))
        by_text = np.argsort(o, kind="stable")  # a text has one label here
        entry = pa.struct([("feature", pa.string()), ("weight", pa.float64())])
        entries = pa.StructArray.from_arrays([grams.take(pa.array(p[by_text])), pa.array(part[by_text])], fields=list(entry))
        return A.lists(o[by_text], len(labels), entries, pa.list_(pa.field("element", entry)), False)

    def found(texts: pa.Array, *labels: pa.Array) -> pa.Array:
        _, known, column, idf, _ = copy.value
        made = []
        for a, b, part, _ in A.single_texts(texts, A.LOOKUP_CHARS):
            of, place, raw = A.known_terms(part, nmin, nmax, known, idf)
            x = raw / A.norms(of, column[place], raw, b - a)[of]
            lists = [for_label(l.slice(a, b - a), of, place, x) for l in labels]
            made.append(pa.StructArray.from_arrays(lists, names=[f"c{i}" for i in range(len(lists))]))
        return pa.concat_arrays(made)

    def of_columns(text: Column, *labels: Column) -> Column:
        kind = ",".join(f"c{i}:{_ENTRIES}" for i in range(len(labels)))

        # Spark wants a plain signature
        if len(labels) == 1:
            @F.arrow_udf(f"struct<{kind}>")
            def one(texts: pa.Array, a: pa.Array) -> pa.Array:
                return found(texts, a)
            return one(text, *labels)

        @F.arrow_udf(f"struct<{kind}>")
        def two(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
            return found(texts, a, b)
        return two(text, *labels)

    return of_columns


def explain_misclassified(predictions: DataFrame, classifier: TextClassifier, nmin: int = 3, nmax: int = 5,
                          k: int = 5, held: int = VOCABULARY_ROWS) -> DataFrame:
    """Per wrong row the n-grams that spoke for the predicted and for the true class.

    Only wrong rows are cut into n-grams. Weights that are few by count are looked up where the rows are; more of them are
    joined with the n-grams of the rows.
    """
    wrong = predictions.where(F.col("label") != F.col("pred_label"))
    weights = classifier.weights(predictions.sparkSession)
    strongest = strongest_ngrams(weights, nmin, nmax, k, held=held)
    if strongest:
        tops = G.clean_column(wrong, "_clean", "normalized_text").withColumn("_tops", strongest(F.col("_clean"), F.col("pred_label"), F.col("label")))
        return tops.select("id", "text", "label", "pred_label", _joined(F.col("_tops.c0")).alias("top_pred_features"),
                           _joined(F.col("_tops.c1")).alias("top_true_features")).distinct()
    wrong = wrong.withColumn("_row", _row_key())
    parts = contributions(wrong.select("_row", "normalized_text").distinct(), weights, nmin, nmax, "_row", "normalized_text")
    tops = top_contributions(parts, k, key="_row")
    listed = tops.select("_row", F.col("label").alias("_class"), _joined(F.col("importance")).alias("_top"))
    found = wrong.select("_row", "id", "text", "label", "pred_label").join(listed, "_row", "left")

    def of(column):
        return F.max(F.when(F.col("_class") == F.col(column), F.col("_top")))

    return found.groupBy("_row", "id", "text", "label", "pred_label").agg(
        of("pred_label").alias("top_pred_features"), of("label").alias("top_true_features")).drop("_row")


def importance_of_prediction(predictions: DataFrame, classifier: TextClassifier, nmin: int = 3, nmax: int = 5,
                             k: int = 5, held: int = VOCABULARY_ROWS) -> DataFrame:
    """The rows with ``importance``: the k n-grams of largest absolute contribution to the predicted class."""
    weights = classifier.weights(predictions.sparkSession)
    strongest = strongest_ngrams(weights, nmin, nmax, k, True, held)
    if strongest:
        tops = G.clean_column(predictions, "_clean", "normalized_text").withColumn("_tops", strongest(F.col("_clean"), F.col("pred_label")))
        return tops.withColumn("importance", F.col("_tops.c0")).drop("_tops", "_clean")
    rows = predictions.withColumn("_row", _row_key())
    asked = rows.select("_row", "normalized_text", "pred_label").distinct()
    parts = contributions(asked, weights, nmin, nmax, "_row", "normalized_text")
    of_prediction = parts.join(asked.select("_row", F.col("pred_label").alias("label")), ["_row", "label"], "left_semi")
    found = top_contributions(of_prediction, k, by_size=True, key="_row").select("_row", "importance")
    return rows.join(found, "_row", "left").drop("_row")


def ngram_range(classifier: TextClassifier) -> tuple[int, int]:
    """Shortest and longest n-gram of the fitted vocabulary."""
    return classifier.features.gram_lengths()
