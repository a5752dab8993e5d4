"""Findings of round 3 on the step that cuts texts into n-grams: white space, look-ups by numbers."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.functions.normalize import WHITESPACE
from labelweave.operators import corpus, gram_arrays, models, ngrams

TEXTS = ["a  b\n\nab a b", "", "  x", " ", " 　⃝", "\U0001f600\U0001f600 ab\t", "\tab  ", "\x85\x85ab \x1f ab", "ab" * 40]


def _grams(text, n):
    text = re.sub(f"[{re.escape(WHITESPACE)}]{{2,}}", " ", text)
    return Counter(text[i:i + n] for i in range(len(text) - n + 1))


@pytest.mark.parametrize("low,high", [(2, 3), (1, 5), (4, 12)])
def test_known_terms_by_brute_force(low, high):
    wanted = {(t, g): c for t, text in enumerate(TEXTS) for n in range(low, high + 1) for g, c in _grams(text, n).items()}
    held = sorted({g for _, g in wanted})[::2] + ["zz", "no such thing"]
    of, place, raw = gram_arrays.known_terms(TEXTS, low, high, gram_arrays.Held(pa.array(held)), np.full(len(held), 0.5))
    found = {(t, held[p]): 2 * v for t, p, v in zip(of.tolist(), place.tolist(), raw.tolist())}
    assert len(found) == len(of)
    assert found == {k: c for k, c in wanted.items() if k[1] in set(held)}


def test_held_ngrams_of_any_length():
    letters = [chr(0x4E00 + i) for i in range(5000)]  # 13 bits each, so five of them do not fit one number
    held = ["".join(letters[i:i + n]) for n in (1, 2, 5, 7) for i in range(0, 4000, 3)]
    look = gram_arrays.Held(pa.array(held))
    for n in (1, 2, 3, 5, 7):
        asked = ["".join(letters[i:i + n]) for i in range(0, 4990)] + ["~" * n]
        points = np.array([[ord(c) for c in g] for g in asked], np.uint32)
        assert look.places(points).tolist() == [held.index(g) if g in set(held) else -1 for g in asked]


def test_counting_needs_no_pattern(spark):
    """White space is collapsed where n-grams are counted; the pattern in the plan took more time than reading and counting."""
    df = spark.createDataFrame([(i, t, "AB"[i % 2]) for i, t in enumerate(TEXTS)], "id long, text string, label string")
    counted = ngrams.document_frequency(df, 2, 3, 1)
    assert "regexp_replace" not in counted._jdf.queryExecution().optimizedPlan().toString()
    wanted = Counter(g for text in TEXTS for n in (2, 3) for g in _grams(text, n))
    assert {r["gram"]: r["df"] for r in counted.collect()} == dict(wanted)
    fitted = models.fit_features(df.withColumn("_norm", F.col("text")), models.TrainConfig(ngram_min=2, ngram_max=3, min_df=1))
    assert fitted.transform(df.withColumn("_norm", F.col("text")), ["id"]).count() == len(TEXTS)


@pytest.mark.parametrize("ranking", [3, 4096])
def test_counts_of_pairs_are_carried_from_round_to_round(spark, ranking, monkeypatch):
    """All pairs are counted again only when none that the driver keeps is left, or a token comes about twice."""
    words = ["abcabc", "aaaa", "xaby", "bc\x03a", "\x02bca", "abab", "cabcab", "zaaab", "bcbcbc"] * 3 + ["abc", "xy"]
    df = spark.createDataFrame([(str(i), f"{w} {w[::-1]}") for i, w in enumerate(words)], "id string, text string")
    counted = []
    whole = corpus.pair_counts
    monkeypatch.setattr(corpus, "pair_counts", lambda table: counted.append(1) or whole(table))
    merges = corpus.learn_merges(df, 12, ranking=ranking)
    table = corpus._written(corpus.word_counts(df).select("n", corpus._as_symbols(F.col("word")).alias("symbols")))
    for i, (left, right, n) in enumerate(merges):
        best = whole(table).orderBy(F.col("n").desc(), "pair").first()
        assert (best["pair"], best["n"]) == (corpus._wrapped(left, right), n)
        table = corpus._written(table, merges[i:i + 1])
    twice = len(merges) - len({a + b for a, b, _ in merges})
    assert len(counted) <= (len(merges) if ranking == 3 else 1 + twice)


@pytest.mark.parametrize("calibrate,folds", [("none", 0), ("temperature", 0), ("platt", 2)])
def test_scores_need_no_vectors(spark, calibrate, folds, monkeypatch):
    """Scores of texts counted in tasks are those of Spark's model on their vectors, and no vector is written for them."""
    df = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad  poor'} {i % 7}", "AB"[i % 2], "xy"[i % 3 == 0]) for i in range(60)] + [(60, "", "A", "y")],
                               "id long, text string, label string, lang string")
    cfg = models.TrainConfig(ngram_min=2, ngram_max=3, min_df=1, max_iter=10, calibrate=calibrate, folds=folds)
    fitted, routed = models.fit(df, cfg, df), models.fit_language_routed(df, cfg)
    read = lambda rows: {r["id"]: {k: round(v, 9) for k, v in r["proba"].items()} for r in rows.select("id", "proba").collect()}
    by_vectors = read(fitted._probabilities(fitted.vectorize(df)))
    monkeypatch.setattr(type(fitted.features), "_vectors", None)
    assert read(fitted.score(df)) == by_vectors
    by_hand = {**read(routed.heads["x"].score(df.where("lang = 'x'"))), **read(routed.heads["y"].score(df.where("lang = 'y'")))}
    assert read(routed.score(df)) == by_hand
