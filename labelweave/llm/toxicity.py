"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned from labelled documents: words and word beginnings whose share among toxic documents is at least
`min_share` and many times their share among the others. Features are rates per word or character: lexicon hits, hits near a second person
pronoun, hits that show only after look-alike characters are undone, capitals, punctuation, and words with characters
mixed in. All of them are column expressions over the whole text; trees and calibration are Spark's own. Training reads a bounded sample of the labelled rows; scoring reads all documents in one pass.

Defined results: a null, empty or blank text has all rates 0 and gets the score of such a row; rows with a null label
or id do not train; an id labelled twice counts as toxic if either label says so; repeated rows are scored alike; when
the training rows hold one class only, every score is that class's share; empty tables give no rows; other columns,
labels, languages and ids are not inputs of the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import bind, bounded, settle, word_array

# Second person words of the corpus languages, and characters written in place of letters.
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch",
                 "usted", "ustedes", "vosotros", "ti")
LOOKALIKE, LETTERS = "013457@$!|*", "oieastasiii"
NAMES = ("hit_rate", "any_hit", "hits", "distinct_hits", "near_rate", "hidden_rate", "upper_rate", "punct_rate", "mixed_rate")


def _lexicon_pattern(words: list[str]) -> str:
    """Pattern of the lexicon's words; `stem*` stands for all words that begin so."""
    body = "|".join(re.escape(w[:-1]) + r"\p{L}*" if w.endswith("*") else re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?iu)(?<!\p{{L}})(?:{body})(?!\p{{L}})"


def features(docs: DataFrame, lexicon: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Dense rates of every whole text; costly counts run only where a cheaper test leaves a chance."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    zero = F.lit(0.0)
    base = docs.select(*keep, body.alias("_t"), F.greatest(F.char_length(body), F.lit(1)).alias("_chars"),
                       F.greatest(count(body, r"\S+"), F.lit(1.0)).alias("_words"),
                       (F.regexp_extract_all(body, F.lit(_lexicon_pattern(lexicon)), 0) if lexicon else F.array().cast("array<string>")).alias("_found"))
    if lexicon:
        hits = F.size("_found").cast("double")
        word = _lexicon_pattern(lexicon).removeprefix("(?iu)")
        person = "|".join(SECOND_PERSON)
        near = F.when(hits > 0, count(F.col("_t"), rf"(?iu)(?<!\p{{L}})(?:{person})(?!\p{{L}})(?:\P{{L}}+\p{{L}}+){{0,3}}\P{{L}}+{word}")
                      + count(F.col("_t"), rf"(?iu){word}(?:\P{{L}}+\p{{L}}+){{0,3}}\P{{L}}+(?:{person})(?!\p{{L}})")).otherwise(zero)
        mixed = F.regexp_extract_all("_t", F.lit(r"\p{L}+[0134579@$!|*]+\p{L}[\p{L}0134579@$!|*]*|[013457@$!|*]\p{L}[\p{L}013457@$!|*]*|\b(?:\p{L}[.\-_ ]){3,}\p{L}\b"), 0)
        plain = F.regexp_replace(F.translate(F.lower(F.array_join("_m", "\n")), LOOKALIKE, LETTERS), r"[.\-_ ]", "")
        base = base.withColumn("_m", mixed)
        hidden = F.when(F.size("_m") > 0, count(plain, _lexicon_pattern(lexicon))).otherwise(zero)
        distinct = F.size(F.array_distinct(F.transform("_found", lambda w: F.lower(w)))).cast("double")
        mixed_rate = F.size("_m") / F.col("_words")
    else:
        hits = near = hidden = distinct = mixed_rate = zero
    columns = {"hit_rate": 100 * hits / F.col("_words"), "any_hit": (hits > 0).cast("double"), "hits": hits, "distinct_hits": distinct,
               "near_rate": 100 * near / F.col("_words"), "hidden_rate": 100 * hidden / F.col("_words"),
               "upper_rate": count(F.col("_t"), r"\p{Lu}") / F.col("_chars"), "punct_rate": count(F.col("_t"), r"[!?*#$%&]") / F.col("_chars"),
               "mixed_rate": mixed_rate}
    return base.select(*keep, *[F.coalesce(c, zero).cast("double").alias(n) for n, c in columns.items()])


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def training_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most `max_rows` labelled ids outside the held-out fifth, chosen by hash."""
    rows = (labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id")
            .agg(F.max("toxic").cast("double").alias("label")))
    return bounded(rows, F.xxhash64("doc_id"), max_rows)


def learn_lexicon(rows: DataFrame, text: str = "text", min_share: float = 0.01, min_lift: float = 20.0, max_words: int = 300) -> list[str]:
    """Words, and word beginnings of four and five letters (`stem*`), frequent among toxic documents and rare elsewhere.

    Near copies of one document would make its words look typical, so one row stays per smallest window hash, twice.
    """
    windows = bind(word_array(F.col(text)), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
                                                                 lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    apart = rows.select("label", text, windows.alias("_v")).select(
        "label", text, F.array_min("_v").alias("_a"), F.array_min(F.transform("_v", lambda h: F.xxhash64(h))).alias("_b"))
    apart = settle(apart.dropDuplicates(["label", "_a"]).dropDuplicates(["label", "_b"]).select("label", text), "toxic-apart")
    totals = apart.agg(F.sum("label").alias("bad"), F.count("label").alias("n")).first()
    bad, other = totals["bad"] or 0.0, (totals["n"] or 0) - (totals["bad"] or 0.0)
    if not bad:
        return []
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}{3,}"), 0))
    stems = lambda w, n: F.transform(F.filter(w, lambda x: F.char_length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))
    terms = bind(found, lambda w: F.concat(w, F.array_distinct(stems(w, 4)), F.array_distinct(stems(w, 5))))
    counted = (apart.select("label", F.explode(terms).alias("w")).groupBy("w").agg(F.sum("label").alias("b"), F.count("label").alias("n"))
               .where(F.col("b") >= max(3.0, min_share * bad)))
    lift = (F.col("b") / bad) / ((F.col("n") - F.col("b") + 0.5) / (other + 1))
    best = [r["w"] for r in counted.where(lift >= min_lift).orderBy(F.desc("b"), "w").limit(max_words).collect()]
    beginnings = tuple(w[:-1] for w in best if w.endswith("*"))
    # a stem that only stands for one listed word adds nothing, and a word under a stem neither
    return [w for w in best if w.endswith("*") and not (len(w) == 6 and w[:4] + "*" in best)
            or not w.endswith("*") and not w.startswith(beginnings)]


@dataclass
class Scorer:
    lexicon: list[str]
    trees: object
    boundaries: list[float]
    levels: list[float]
    constant: float | None = None

    def _calibrated(self, raw: Column) -> Column:
        """Piecewise linear between the fitted boundaries."""
        x, y = self.boundaries, self.levels
        out = F.lit(y[-1])
        for i in range(len(x) - 1, 0, -1):
            width = x[i] - x[i - 1]
            inside = F.lit(y[i]) if width <= 0 else F.lit(y[i - 1]) + (raw - x[i - 1]) * ((y[i] - y[i - 1]) / width)
            out = F.when(raw < x[i], inside).otherwise(out)
        return F.when(raw <= x[0], F.lit(y[0])).otherwise(out)

    def score(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        rows = features(docs, self.lexicon, text, keep)
        if self.constant is not None:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        raw = vector_to_array(F.col("probability"))[1]
        scored = self.trees.transform(VectorAssembler(inputCols=list(NAMES), outputCol="_x").transform(rows)).select(*keep, raw.alias("_raw"))
        # a little of the raw score keeps the order within the steps of the calibration
        mixed = 0.999 * self._calibrated(F.col("_raw")) + 0.001 * F.col("_raw")
        return scored.select(*keep, F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 20_000, trees: int = 20, depth: int = 4) -> Scorer:
    """Scorer from the labelled rows outside the held-out fifth; `max_labelled` bounds them.

    A quarter of them, by hash, calibrates what the others train.
    """
    sample = training_labels(labels, max_labelled)
    rows = settle(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id"), "toxic-rows")
    lexicon = learn_lexicon(rows)
    data = settle(features(rows, lexicon, keep=("doc_id", "label")), "toxic-features")
    share = data.agg(F.avg("label").alias("share"), F.count("label").alias("n")).first()
    if not share["n"] or share["share"] in (0.0, 1.0):
        return Scorer(lexicon, None, [], [], share["share"] if share["n"] else 0.0)
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="_x").transform(data.coalesce(6))
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=7, stepSize=0.2).fit(vectors.where(~calibrates))
    kept = model.transform(vectors.where(calibrates)).select(vector_to_array(F.col("probability"))[1].alias("_raw"), "label")
    if not kept.take(1):
        return Scorer(lexicon, model, [0.0, 1.0], [0.0, 1.0])
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(kept)
    return Scorer(lexicon, model, list(curve.boundaries), list(curve.predictions))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
