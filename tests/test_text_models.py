import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import perturb as T
from labelweave.operators import features
from labelweave.operators import corpus as C
from labelweave.operators import explain as E
from labelweave.operators import models
from labelweave.operators import ngrams as G
from labelweave.operators.models import TextClassifier, TrainConfig
from labelweave.plans import evaluation, reporting, training

GOOD, BAD, FLAT = "good fine nice happy", "bad awful poor sad", "table chair door wall"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(150):
        label, words = [("POS", GOOD), ("NEG", BAD), ("NEU", FLAT)][i % 3]
        data.append((str(i), " ".join(rng.choice(words.split(), 4)), label, "en" if i % 2 else "km", i))
    return spark.createDataFrame(data, "id string, text string, label string, lang string, seq long")


CFG = TrainConfig(ngram_min=2, ngram_max=3, max_iter=15)


@pytest.fixture(scope="module")
def result(rows):
    return training.train_and_evaluate(rows, CFG)


def test_ngrams_by_hand(spark):
    df = spark.createDataFrame([("1", "ab😀c"), ("2", ""), ("3", "a")], "id string, text string")
    got = {r["id"]: r["g"] for r in df.select("id", G.char_ngrams("text", 2, 3).alias("g")).collect()}
    assert got == {"1": ["ab", "b😀", "😀c", "ab😀", "b😀c"], "2": [], "3": []}


def test_tfidf_by_brute_force(spark):
    texts = {"1": "abab", "2": "abc  d", "3": "zz"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(r["id"], r["gram"]): r["weight"] for r in G.tfidf(df, 2, 2).collect()}
    bags = {k: Counter(a + b for a, b in zip(t, t[1:])) for k, t in ((k, re.sub(r"\s\s+", " ", t)) for k, t in texts.items())}
    freq = Counter(g for b in bags.values() for g in b)
    for k, bag in bags.items():
        raw = {g: n * (np.log(4 / (1 + freq[g])) + 1) for g, n in bag.items()}
        size = np.sqrt(sum(v * v for v in raw.values()))
        for g, v in raw.items():
            assert got[(k, g)] == pytest.approx(v / size)


def test_training_learns_and_probabilities_are_named(result):
    scores = {r["split"]: r["accuracy"] for r in result.scores.collect()}
    assert scores["test"] > 0.9
    rows = result.predictions.select("proba", "pred_label", "confidence").collect()
    assert all(max(r["proba"], key=r["proba"].get) == r["pred_label"] for r in rows)
    assert all(sum(r["proba"].values()) == pytest.approx(1.0) for r in rows)


def test_model_features_equal_long_form(spark, rows, result):
    vocabulary = result.classifier.vocabulary()
    train = rows.join(result.predictions.select("id"), "id", "left_anti")
    long = {(r["id"], r["gram"]): r["weight"] for r in G.tfidf(train, 2, 3, min_df=2).collect()}
    one = result.classifier.vectorize(train).limit(5).collect()
    for r in one:
        v = r["features"]
        for i, x in zip(v.indices, v.values):
            assert long[(r["id"], vocabulary[i])] == pytest.approx(x)


def test_save_and_load(spark, rows, result, tmp_path):
    result.classifier.save(str(tmp_path / "m"))
    again = TextClassifier.load(str(tmp_path / "m"))
    a = {r["id"]: r["confidence"] for r in result.classifier.score(rows).collect()}
    b = {r["id"]: r["confidence"] for r in again.score(rows).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("method,folds", [("temperature", 0), ("platt", 0), ("isotonic", 0), ("platt", 2)])
def test_calibrated_models(rows, tmp_path, method, folds):
    cfg = TrainConfig(ngram_min=2, ngram_max=2, max_iter=8, calibrate=method, folds=folds)
    fitted = models.fit(rows.where("seq < 90"), cfg, rows.where("seq >= 90"))
    fitted.save(str(tmp_path / "m"))
    out = TextClassifier.load(str(tmp_path / "m")).score(rows.where("seq >= 90")).collect()
    assert len(out) == 60
    assert all(sum(r["proba"].values()) == pytest.approx(1.0) for r in out)
    assert np.mean([r["label"] == r["pred_label"] for r in out]) > 0.8


def test_explanations(spark, rows, result):
    weights = result.classifier.weights(spark)
    top = E.top_features(weights, 3)
    assert top.groupBy("label").count().agg(F.max("count")).first()[0] == 6
    everything = result.classifier.score(rows).withColumn("label", F.lit("NEG"))
    wrong = E.explain_misclassified(everything, result.classifier, 2, 3).first()
    assert "|" in wrong["top_pred_features"]
    record = evaluation.request_records(rows.limit(5), result.classifier, 0.5, importance=2).first()
    assert len(record["importance"]) == 2 and record["top"][0]["label"] == record["pred_label"]


def test_hashed_features_have_names_and_a_floor(spark, rows):
    from dataclasses import replace

    cfg = replace(CFG, features="hashed", num_features=1 << 12, min_df=3)
    rare = spark.createDataFrame([("r1", "good qqxxqq", "POS", "en", 900), ("r2", "bad qqxxqq", "NEG", "en", 901)], rows.schema)
    fitted = models.fit(rows.unionByName(rare).withColumn("split", F.lit("train")), cfg)
    names = set(fitted.vocabulary())
    assert {"go", "good"[:3]} <= names and not {"qq", "qqx", "xq"} & names
    weights = fitted.weights(spark)
    assert {r["feature"] for r in E.top_features(weights, 5).collect()} <= names
    scored = fitted.score(rows).persist()
    assert scored.where("label = pred_label").count() > 140
    found = E.importance_of_prediction(scored, fitted, 2, 3, k=2)
    assert found.count() == rows.count() and found.where("size(importance) = 2").count() == rows.count()
    parts = E.contributions(scored.limit(5), weights, 2, 3, text="normalized_text").groupBy("id", "label").agg(F.sum("contribution").alias("s"))
    margins = {(r["id"], l): v for r in scored.select("id", "logits").collect() for l, v in r["logits"].items()}
    whole = [margins[r["id"], r["label"]] - r["s"] for r in parts.collect() if r["label"] == "POS"]
    assert max(whole) - min(whole) < 1e-6  # what is left is the intercept
    with pytest.raises(ValueError, match="unknown features"):
        models.fit(rows, replace(CFG, features="odd"))


@pytest.mark.parametrize("kind", ["vocabulary", "hashed"])
def test_vectors_joined_equal_vectors_looked_up(spark, rows, kind):
    """Both plans of one index: the same columns and values, also for repeated rows, null, empty and unknown texts."""
    from dataclasses import replace

    fitted = features.fit_features(rows.select(F.col("text").alias("_norm")), 2, 4, 2, kind, 1 << 10)
    assert fitted.held
    odd = spark.createDataFrame([("n", None), ("e", ""), ("u", "@@@@"), ("w", "good  \t fine"), ("w", "good  \t fine")], "id string, _norm string")
    asked = rows.select("id", F.col("text").alias("_norm")).unionByName(odd)
    wide = replace(fitted, held=False)
    entries = lambda v: tuple((int(i), round(float(x), 9)) for i, x in zip(v.indices, v.values) if x)
    read = lambda f: sorted((r["id"], r["features"].size, entries(r["features"]))
                            for r in f.transform(asked).where("_norm is not null").select("id", "features").collect())
    assert read(wide) == read(fitted) and len(read(wide)) == rows.count() + 4
    unknown = "id in ('n', 'u')" if kind == "vocabulary" else "id = 'n'"  # an unknown n-gram may share a hashed column
    assert {r["features"].numNonzeros() for r in wide.transform(asked).where(unknown).collect()} == {0}


def test_index_numbers_every_gram_once(spark, rows):
    fitted = features.fit_features(rows.select(F.col("text").alias("_norm")), 2, 4, 2)
    found = fitted.index.collect()
    assert sorted(r["column"] for r in found) == list(range(fitted.size)) and len({r["gram"] for r in found}) == fitted.size
    df = {r["gram"]: r["df"] for r in G.document_frequency(rows, 2, 4, 2).collect()}
    assert {r["gram"]: r["idf"] for r in found} == pytest.approx({g: np.log((1 + rows.count()) / (1 + n)) + 1 for g, n in df.items()})


def test_training_without_a_copy_of_the_index(spark, rows, result, monkeypatch):
    """A model whose index no task holds scores as one whose index is held."""
    monkeypatch.setattr(features, "HELD_COLUMNS", 0)
    train = rows.where("seq < 100")
    wide = models.fit(train, CFG)
    assert not wide.features.held
    monkeypatch.undo()
    held = models.fit(train, CFG)
    a, b = ({r["id"]: r["confidence"] for r in m.score(rows).collect()} for m in (wide, held))
    assert a == pytest.approx(b, abs=1e-6) and len(a) == rows.count()


def test_fold_calibrators_keep_copies_of_an_id(rows):
    from dataclasses import replace

    twice = rows.unionByName(rows.where("seq < 10"))
    fitted = models.fit(twice, replace(CFG, calibrate="platt", folds=3))
    scored = fitted.score(twice)
    assert scored.count() == 160 and scored.select("id").distinct().count() == 150
    assert scored.where(F.abs(F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_one_id_with_two_texts_is_explained_apart(spark, result):
    rows = spark.createDataFrame([("x", "good fine nice happy", "NEG"), ("x", "bad awful poor sad", "POS")], "id string, text string, label string")
    wrong = E.explain_misclassified(result.classifier.score(rows), result.classifier, 2, 3).collect()
    assert len(wrong) == 2 and len({r["top_pred_features"] for r in wrong}) == 2


def test_refused_texts_come_back(spark, rows, result):
    asked = rows.limit(3).select("id", "text").unionByName(spark.createDataFrame([("long", "x" * 50), ("blank", " ")], "id string, text string"))
    out = {r["id"]: (r["reason"], r["pred_label"]) for r in evaluation.request_records(asked, result.classifier, importance=1, max_chars=40).collect()}
    assert len(out) == 5 and out["long"] == ("too_long", None) and out["blank"] == ("empty", None)
    assert all(reason is None and label for i, (reason, label) in out.items() if i not in ("long", "blank"))


def test_separators_count_as_white_space(spark):
    df = spark.createDataFrame([("a\x1c\x1db  c",)], "text string")
    assert df.select(G.collapse_spaces("text").alias("t")).first()["t"] == "a b c"


def test_runs_read_what_was_written(spark, tmp_path):
    from labelweave.sinks import tables as K
    from labelweave.sources import runs

    for name in ("m1", "m2"):
        K.write_metrics(spark, str(tmp_path / name / "metrics.json"), test={"accuracy": 0.5 if name == "m1" else 0.75})
    (tmp_path / "m1" / "env.json").write_text('{"python": 3}')
    (tmp_path / "m3").mkdir()
    (tmp_path / "m3" / "metrics.json").write_text("{broken")
    rows = runs.overall(runs.read_runs(spark, [str(tmp_path)])).collect()
    assert sorted((r["model"].rsplit("/", 1)[1], r["test_accuracy"]) for r in rows) == [("m1", 0.5), ("m2", 0.75)]
    ordered = runs.read_runs(spark, [str(tmp_path / "m2"), str(tmp_path / "m*"), str(tmp_path / "m1" / "metrics.json")]).orderBy("place").collect()
    assert [r["model"].rsplit("/", 1)[1] for r in ordered] == ["m2", "m1"]
    assert runs.read_runs(spark, []).count() == 0


def test_tiny_corpus_falls_back(spark):
    tiny = spark.createDataFrame([("1", "ab", "POS"), ("2", "cd", "NEG")], "id string, text string, label string")
    fitted = models.fit(tiny, TrainConfig(min_df=2, max_iter=5))
    assert set(fitted.vocabulary()) == {"a", "b", "ab", "c", "d", "cd"}
    with pytest.raises(ValueError):
        models.fit(tiny.where("label = 'POS'"), TrainConfig(max_iter=5))


def test_language_routing(rows):
    routed = models.fit_language_routed(rows, TrainConfig(ngram_min=2, ngram_max=2, max_iter=8))
    assert set(routed.heads) == {"en", "km"}
    out = routed.score(rows.withColumn("lang", F.lit("xx")))
    assert out.where("label = pred_label").count() > 120


def test_stress_conformal_and_loop(rows, result):
    scores, scored = evaluation.stress_test(rows.withColumn("category", F.col("lang")), result.classifier, "emoji_burst", 0.9)
    assert scores.count() == 3 and scored.where(F.col("text").rlike(r"\x{1F600}")).count() > 0
    sets, coverage, tau = evaluation.conformal_predictions(rows, result.classifier, 0.9, 0.4)
    assert 0 <= tau <= 1 and coverage.first()["n"] == 90
    logged = rows.where("seq < 5")
    queue = evaluation.error_loop(result.predictions.withColumn("label", F.lit("POS")), logged, "random", 4)
    assert queue.count() == 4 and queue.first()["note"].startswith("- Item ID:")


@pytest.mark.parametrize("name", sorted(T.TRANSFORMS))
def test_transforms(spark, name):
    texts = ["hello ករាំ world ១២", "", "ស្រី", "zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    a = [r[0] for r in df.select(T.perturb(name, "text", "id", 0.9, seed=1)).collect()]
    b = [r[0] for r in df.repartition(3).orderBy("id").select(T.perturb(name, "text", "id", 0.9, seed=1)).collect()]
    assert a == b and a[0]
    same = [r[0] for r in df.select(T.perturb(name, "text", "id", 0.9, prob=0.0)).collect()]
    assert same == texts


def test_draw_rate(spark):
    df = spark.range(40).select("id", F.repeat(F.lit("a"), 2000).alias("text"))
    share = df.select(F.avg(F.length(T.perturb("zero_width", "text", "id", 1.0)) - 2000) / 2000).first()[0]
    assert share == pytest.approx(0.2, abs=0.01)


def test_merges_by_brute_force(spark):
    texts = ["low lower lowest low", "new newer newest wide"]
    words = Counter(w for t in texts for w in re.findall(r"\w+|[^\w\s]+", t))
    state, expected = {w: list(w) for w in words}, []
    for _ in range(6):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(state[w], state[w][1:]):
                pairs[p] += n
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        expected.append((a, b, n))
        for w, s in state.items():
            i, out = 0, []
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == (a, b)
                out.append(a + b if hit else s[i])
                i += 2 if hit else 1
            state[w] = out
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, text string, seq long")
    assert C.learn_merges(df, 6) == expected
    assert C.learn_merges(df, 50, min_frequency=4)[-1][2] >= 4
    stats = C.corpus_statistics(df, 6).first()
    assert stats["held_out"] == 1
    assert stats["avg_tokens"] == sum(len(state[w]) for w in texts[1].split()) + 2


def test_sweep_reports_failures(rows):
    out = training.sweep(rows, TrainConfig(ngram_min=2, ngram_max=2, max_iter=3), {"calibrate": ["none", "odd"]}).collect()
    assert {r["run"]: r["status"][:2] for r in out} == {"calibrate_none": "ok", "calibrate_odd": "fa"}


def test_whole_chain(spark, rows, tmp_path):
    tables = reporting.whole_chain(rows.select("id", "text", "label", "seq"), str(tmp_path), CFG, "r1", num_merges=3)
    assert tables["scores"].count() == 2 and tables["issues"].count() == 0
    from labelweave.sources import runs
    listed = runs.model_listing(spark, str(tmp_path), runs.read_runs(spark, [str(tmp_path / "r1")]))
    assert listed.where("type = 'linear'").count() == 1
    assert spark.read.parquet(str(tmp_path / "runs" / "metrics")).where("run = 'r1'").count() == 4


def test_batches_of_merges_equal_single_merges(spark):
    import random

    rng = random.Random(11)
    for alphabet in ("ab", "abcdefghijkl"):
        texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(12)) for _ in range(20)]
        words = Counter(w for t in texts for w in t.split())
        table, single = {w: list(w) for w in words}, []
        while len(single) < 15:
            pairs = Counter()
            for w, symbols in table.items():
                for a, b in zip(symbols, symbols[1:]):
                    pairs[(a, b)] += words[w]
            # pairs are ordered as their wrapped texts are
            best = min((p for p, n in pairs.items() if n >= 2), key=lambda p: (-pairs[p], f"\x02{p[0]}\x03\x02{p[1]}\x03"), default=None)
            if best is None:
                break
            single.append((*best, pairs[best]))
            for symbols in table.values():
                i = 0
                while i < len(symbols) - 1:
                    if (symbols[i], symbols[i + 1]) == best:
                        symbols[i:i + 2] = [best[0] + best[1]]
                    i += 1
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
        assert C.learn_merges(df, 15, ranking=16) == single
