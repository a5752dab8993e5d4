import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import proba as P
from labelweave.operators import calibration as C
from labelweave.operators import compare
from labelweave.operators import conformal as X
from labelweave.operators import metrics as M
from labelweave.operators import review as R

# A published confusion matrix (rows gold, order POS NEG NEU) and its scores.
CONFUSION = [[78, 4, 4], [1, 76, 3], [5, 4, 73]]
ORDER = ("POS", "NEG", "NEU")
# Fixed values: (pred, gold, proba of POS, NEG, NEU) of fifteen test rows; true column order.
SMALL = ["POS POS", "POS POS", "POS POS", "POS POS", "POS NEG", "NEG NEG", "NEG NEG", "NEG POS", "NEG NEG", "NEG POS",
         "NEU NEU", "NEU NEG", "NEU NEG", "NEU NEU", "NEU POS"]
# Fixed values: (count, accuracy, confidence) of the filled bins, the first one being bin 6 of 15.
BINS = [(9, 0.6666666666666666, 0.37717291040324064), (17, 0.5294117647058824, 0.43600200395872746),
        (26, 0.8846153846153846, 0.49475385254013055), (27, 0.8518518518518519, 0.5586104701849978),
        (31, 0.9354838709677419, 0.6268735437197586), (28, 0.9642857142857143, 0.7043421305396755),
        (43, 1.0, 0.7636791475579399), (38, 1.0, 0.8371428841683147), (25, 1.0, 0.9015642448972475),
        (4, 1.0, 0.9447451344049818)]


def test_published_confusion(spark):
    counts = spark.createDataFrame([(ORDER[i], ORDER[j], n) for i, row in enumerate(CONFUSION) for j, n in enumerate(row)],
                                   "gold string, pred string, n long")
    row = M.summary(counts).first()
    assert row["n"] == 248
    assert row["accuracy"] == pytest.approx(0.915323, abs=1e-6)
    assert row["f1_macro"] == pytest.approx(0.915237, abs=1e-6)
    report = {r["label"]: r for r in M.report(counts).collect()}
    assert [round(report[l]["f1"], 4) for l in ORDER] == [0.9176, 0.9268, 0.9012]
    assert report["macro avg"]["support"] == 248
    back = {r["gold"]: [r[f"pred_{l}"] for l in ORDER] for r in M.confusion(counts).collect()}
    assert [back[l] for l in ORDER] == CONFUSION


def test_small_run(spark):
    rows = spark.createDataFrame([tuple(x.split()) for x in SMALL], "label string, pred_label string")
    row = M.summary(M.count_table(rows)).first()
    assert row["accuracy"] == pytest.approx(0.6) and row["f1_macro"] == pytest.approx(0.594517, abs=1e-6)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "label string, pred_label string, confidence double")
    row = M.summary(M.count_table(empty)).first()
    assert (row["n"], row["accuracy"], row["f1_macro"]) == (0, None, None)
    assert M.report(M.count_table(empty)).count() == 0
    bins = C.reliability_bins(empty, 10, "midpoint")
    assert bins.count() == 0
    assert tuple(C.calibration_error(bins).first()) == (0.0, 0.0)
    assert C.reliability_bins(empty, 10).count() == 10


def test_published_bins(spark):
    bins = spark.createDataFrame(BINS, "count long, accuracy double, confidence double")
    row = C.calibration_error(bins).first()
    assert row["ece"] == pytest.approx(0.234375, abs=1e-6) and row["mce"] == pytest.approx(0.389862, abs=1e-6)


def test_bin_edges_agree_with_comparisons(spark):
    for n in (10, 15):
        edges = np.linspace(0, 1, n + 1)
        rows = spark.range(0, 10_001).select((F.col("id") / 10_000.0).alias("c"))
        edge_rows = spark.createDataFrame([(float(e),) for e in edges], "c double")
        for r in rows.unionByName(edge_rows).select("c", C.bin_number(F.col("c"), n).alias("b")).collect():
            lo, hi = edges[r["b"] - 1], edges[r["b"]]
            assert (lo < r["c"] <= hi) or (r["b"] == 1 and r["c"] == 0.0)


def predictions(spark, probs, gold):
    rows = [(i, g, *p) for i, (p, g) in enumerate(zip(probs, gold))]
    df = spark.createDataFrame(rows, "id long, label string, POS double, NEG double, NEU double")
    return df.withColumn("proba", F.create_map(*[x for l in ORDER for x in (F.lit(l), F.col(l))])).withColumn(
        "pred_label", P.argmax_label("proba"))


def test_argmax_names_the_largest_column(spark):
    rows = predictions(spark, [(0.2, 0.5, 0.3), (0.4, 0.2, 0.4), (0.1, 0.1, 0.8)], ["NEG", "POS", "NEU"])
    assert [r["pred_label"] for r in rows.orderBy("id").collect()] == ["NEG", "NEU", "NEU"]


def test_uncertainty_and_sets(spark):
    rows = R.with_confidence(predictions(spark, [(0.5, 0.3, 0.2)], ["POS"])).withColumn("h", P.entropy("proba"))
    r = X.prediction_sets(rows, 0.7).first()
    assert (r["confidence"], round(r["margin"], 6), r["pred_set"], r["set_size"]) == (0.5, 0.2, ["POS", "NEG"], 2)
    assert r["h"] == pytest.approx(-sum(p * math.log(p + 1e-12) for p in (0.5, 0.3, 0.2)))
    top = rows.select(P.top_classes("proba", 9).alias("t")).first()["t"]
    assert [e["label"] for e in top] == ["POS", "NEG", "NEU"]
    one = spark.createDataFrame([({"POS": 0.7},)], "proba map<string,double>")
    assert R.with_confidence(one).select("confidence", "margin").first() == (0.7, 0.7)


def test_tau_is_the_higher_quantile(spark):
    rng = np.random.default_rng(0)
    probs = rng.dirichlet([1, 1, 1], 57)
    gold = [ORDER[i] for i in rng.integers(0, 3, 57)]
    rows = predictions(spark, [tuple(map(float, p)) for p in probs], gold)
    scores = 1 - np.array([p[ORDER.index(g)] for p, g in zip(probs, gold)])
    q = math.ceil(58 * (1 - (1 - 0.9))) / 57
    expected = np.quantile(scores, min(q, 1.0), method="higher")
    assert X.fit_tau(rows, coverage=0.9) == pytest.approx(expected)
    assert X.fit_tau(rows.where("id < 0")) == X.DEFAULT_TAU
    with pytest.raises(Exception, match="unknown label"):
        X.fit_tau(rows.withColumn("label", F.lit("ODD")))
    sets = X.prediction_sets(rows, float(expected))
    assert X.coverage(sets).first()["coverage"] >= 0.9


def test_temperature_minimises_loss(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(200, 3)) * 4
    gold = [ORDER[int(np.argmax(z + rng.gumbel(size=3) * 2))] for z in logits]
    df = spark.createDataFrame([(g, dict(zip(ORDER, map(float, z)))) for g, z in zip(gold, logits)],
                               "label string, logits map<string,double>")

    def loss(t):
        z = logits / t
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -np.mean(np.log(np.clip(p[np.arange(200), [ORDER.index(g) for g in gold]], 1e-12, 1)))

    best = C.fit_temperature(df)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.linspace(0.5, 5, 91))


def test_pr_curve_by_brute_force(spark):
    rng = np.random.default_rng(2)
    probs = np.round(rng.dirichlet([1, 1, 1], 80), 1)
    gold = [ORDER[i] for i in rng.integers(0, 3, 80)]
    rows = predictions(spark, [tuple(map(float, p)) for p in probs], gold)
    points = C.pr_points(rows, bins=5)
    got = {(r["class"], r["threshold"]): (r["precision"], r["recall"]) for r in points.collect()}
    for k, l in enumerate(ORDER):
        truth = np.array([g == l for g in gold])
        for t in set(probs[:, k]):
            chosen = probs[:, k] >= t
            assert got[(l, t)] == pytest.approx((truth[chosen].mean(), truth[chosen].sum() / truth.sum()))
    absent = C.pr_points(rows.where("label = 'POS'"))
    ap = {r["class"]: r["average_precision"] for r in C.average_precision(absent).collect()}
    assert ap["POS"] == pytest.approx(1.0) and ap["NEG"] == 0.0


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    gold = rng.integers(0, 3, 400)
    a = np.where(rng.random(400) < 0.7, gold, rng.integers(0, 3, 400))
    b = np.where(rng.random(400) < 0.9, gold, rng.integers(0, 3, 400))
    side = lambda p: spark.createDataFrame([(i, ORDER[g], ORDER[q]) for i, (g, q) in enumerate(zip(gold, p))],
                                           "id long, label string, pred_label string")
    out = {r["score"]: r for r in compare.paired_bootstrap(side(a), side(b), 500).collect()}
    assert out["acc_a"]["point"] == pytest.approx((gold == a).mean())
    rows = [rng.integers(0, 400, 400) for _ in range(500)]
    by_rows = np.percentile([(gold == b)[i].mean() - (gold == a)[i].mean() for i in rows], [2.5, 97.5])
    assert (out["acc_delta"]["low"], out["acc_delta"]["high"]) == pytest.approx(tuple(by_rows), abs=0.02)
    again = {r["score"]: r for r in compare.paired_bootstrap(side(a).repartition(5), side(b), 500).collect()}
    assert out == again
    aligned = compare.align(side(a), side(b)).unionByName(compare.align(side(a), side(b)))
    doubled = compare.joint_counts(side(a).unionByName(side(a)), side(b))
    assert sorted(map(tuple, doubled.collect())) == sorted(map(tuple, aligned.groupBy("label", "pred_a", "pred_b").count().collect()))
    with pytest.raises(Exception, match="gold labels differ"):
        compare.align(side(a), side(b).withColumn("label", F.lit("POS"))).collect()
    with pytest.raises(ValueError):
        compare.bootstrap_replicates(side(a).where("id < 0"), side(b))


def test_error_numbers(spark):
    rows = spark.createDataFrame([("1", "t", "pos", "NEG", "0.2", "0.7", "0.1", "", "0.5"), ("2", "t", "POS", "NEG", "", "", "", "0.9", "0")],
                                 "id string, text string, label string, pred_label string, proba_POS string, proba_NEG string, "
                                 "proba_NEU string, confidence string, margin string")
    a, b = R.fill_uncertainty(rows).orderBy("id").collect()
    assert (a["confidence"], round(a["margin"], 6)) == (0.7, 0.5)
    assert (b["confidence"], b["margin"]) == (0.9, 0.0)


def test_grid():
    assert compare.parameter_grid({}) == [{}]
    grid = compare.parameter_grid({"b": [1, 2], "a": [True]})
    assert grid == [{"a": True, "b": 1}, {"a": True, "b": 2}]
    assert compare.combo_name(grid[0]) == "a_true__b_1"
