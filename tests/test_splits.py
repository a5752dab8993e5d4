import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import ordering as O
from labelweave.operators import quality as Q
from labelweave.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(600).select(
        n.cast("string").alias("id"), F.when(n % 3 == 0, "POS").when(n % 3 == 1, "NEG").otherwise("NEU").alias("label"),
        F.when(n % 2 == 0, "en").alias("lang"), F.when(n % 5 != 0, F.concat(F.lit("g"), (n % 40).cast("string"))).alias("group"),
        n.alias("seq"))


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_stratified_counts_do_not_depend_on_partitions(rows, parts):
    out = S.stratified_split(rows.repartition(parts), 0.8, 0.1, 0.1)
    assert sizes(out) == {"train": 480, "val": 60, "test": 60}
    per = out.groupBy("label", "split").count().collect()
    assert {r["count"] for r in per if r["split"] == "val"} == {20}


def test_split_equals_itself_under_repartition(rows):
    a = S.stratified_split(rows.repartition(1), 0.7, 0.2, 0.1, by_lang=True)
    b = S.stratified_split(rows.repartition(9), 0.7, 0.2, 0.1, by_lang=True)
    assert a.select("id", "split").exceptAll(b.select("id", "split")).isEmpty()


def test_ratios_are_checked(rows):
    for bad in ((0.8, 0.1, 0.2), (1.0, 0.0, 0.0), (0.0, 0.5, 0.5)):
        with pytest.raises(ValueError):
            S.stratified_split(rows, *bad)


def test_zero_shares(rows):
    assert sizes(S.stratified_split(rows, 0.9, 0.0, 0.1)) == {"train": 540, "test": 60}
    assert set(sizes(S.group_split(rows, 0.5, 0.5, 0.0))) == {"train", "val"}


def test_groups_never_cross(rows):
    for out in (S.group_split(rows, 0.6, 0.2, 0.2), S.group_stratified_split(rows, 0.6, 0.2, 0.2),
                S.group_stratified_split(rows, 0.6, 0.2, 0.2, by_lang=True)):
        assert out.count() == 600 and out.where("split is null").isEmpty()
        assert Q.splits_disjoint(out)


def _one_by_one(counts, targets):
    """The rule as it is stated: a loop over groups."""
    filled, out = [[0] * len(t) for t in targets], []
    for row in counts:
        cost = [sum(abs(h + c - t) for h, c, t in zip(have, row, aim)) for have, aim in zip(filled, targets)]
        side = cost.index(min(cost))
        filled[side] = [h + c for h, c in zip(filled[side], row)]
        out.append(side)
    return out


@pytest.mark.parametrize("shares", [(0.6, 0.2, 0.2), (0.8, 0.1, 0.1), (0.34, 0.33, 0.33), (1.0, 0.0, 0.0)])
def test_greedy_sides_equal_the_loop(shares):
    rng = np.random.default_rng(7)
    for buckets, n in ((1, 500), (3, 3000), (9, 700)):
        counts = np.sort(rng.integers(0, 6, (n, buckets)) * (rng.random((n, buckets)) < 0.4), axis=0)[::-1].astype(float)
        targets = np.array([[counts[:, b].sum() * s for b in range(buckets)] for s in shares])
        filled = np.zeros_like(targets)
        assert S.greedy_sides(filled, targets, counts).tolist() == _one_by_one(counts.tolist(), targets.tolist())
        assert filled.sum() == counts.sum()


def test_more_groups_than_fit_a_block(spark):
    """120,000 groups, most of them of one or two rows, in several blocks: the loop's splits, whatever the partitions."""
    n = F.col("id")
    rows = spark.range(200_000).select(
        n.cast("string").alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("POS", "NEG", "NEU", "POS")]), (F.pmod(F.hash("id"), F.lit(4)) + 1)).alias("label"),
        F.when(n % 5 != 0, F.concat(F.lit("g"), F.pmod(F.xxhash64("id"), F.lit(90_000)).cast("string"))).alias("group"))
    before, S.GROUPS_PER_BLOCK = S.GROUPS_PER_BLOCK, 30_000
    try:
        out = S.group_stratified_split(rows, 0.7, 0.2, 0.1)
        got = {r["_g"]: r["split"] for r in out.groupBy(S.group_key().alias("_g")).agg(F.min("split").alias("split")).collect()}
        assert Q.splits_disjoint(out)
    finally:
        S.GROUPS_PER_BLOCK = before
    cells = rows.groupBy(S.group_key().alias("g")).agg(*[F.sum((F.col("label") == b).cast("int")).alias(b) for b in ("NEG", "NEU", "POS")]).collect()
    cells.sort(key=lambda r: (-(r["NEG"] + r["NEU"] + r["POS"]), r["g"]))
    counts = [[r["NEG"], r["NEU"], r["POS"]] for r in cells]
    targets = [[sum(c[b] for c in counts) * share for b in range(3)] for share in (0.7, 0.2, 0.1)]
    assert len(cells) > 110_000
    assert got == {r["g"]: ("train", "val", "test")[s] for r, s in zip(cells, _one_by_one(counts, targets))}


def test_groups_of_no_rows(rows):
    assert S.group_stratified_split(rows.limit(0), 0.6, 0.2, 0.2).count() == 0


def test_greedy_by_hand(spark):
    """Three equal groups: the second target that is closest takes each in turn."""
    three = spark.range(30).select(F.col("id").cast("string").alias("id"), F.lit("POS").alias("label"),
                                   F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("group"))
    out = S.group_stratified_split(three, 0.8, 0.1, 0.1)
    assert {r["group"]: r["split"] for r in out.select("group", "split").distinct().collect()} == {
        "g0": "val", "g1": "test", "g2": "train"}


def test_few_groups(spark):
    one = spark.createDataFrame([("1", "POS", "a"), ("2", "NEG", "a")], "id string, label string, group string")
    assert S.group_split(one, 0.5, 0.25, 0.25).count() == 2
    none = one.withColumn("group", F.lit(" "))
    assert "split" in S.group_split_or_stratified(none, 0.5, 0.25, 0.25).columns


def test_resampling(rows):
    skewed = rows.where("label = 'POS' or cast(id as int) < 120")
    up = S.oversample(skewed).groupBy("label").count().collect()
    assert {r["count"] for r in up} == {200}
    down = S.undersample(skewed).groupBy("label").count().collect()
    assert {r["count"] for r in down} == {40}
    assert S.undersample(skewed, 0.0).groupBy("label").count().agg(F.max("count")).first()[0] == 40
    assert S.hold_out(rows, 0.25).where("held_out").count() == 150


def test_copies_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(S, "COPY_BLOCK", 3)
    few = rows.where("label = 'POS' or cast(id as int) < 30")
    out = S.oversample(few)
    assert {r["count"] for r in out.groupBy("label").count().collect()} == {200}
    assert out.select("id", "copy").distinct().count() == out.count()
    assert out.groupBy("label").agg(F.max("copy").alias("m")).where("label = 'NEG'").first()["m"] == 20


def test_repair(spark):
    rows = spark.createDataFrame([("1", "POS", "train"), ("2", "POS", "train"), ("3", "NEG", "test"), ("4", "NEG", "test")],
                                 "id string, label string, split string")
    out = S.repair_splits(rows)
    assert out.where("split = 'train'").select("label").distinct().count() == 2
    assert set(sizes(out)) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        S.repair_splits(rows.where("label = 'POS'"))


def test_copies_of_one_key_stay_together(spark):
    copies = spark.range(900).select(F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("id"),
                                     F.lit("POS").alias("label"))
    out = S.stratified_split(copies, 0.5, 0.25, 0.25)
    assert out.count() == 900
    assert out.where("id = 'hot'").select("split").distinct().count() == 1


def test_value_at_rank_narrows_exactly(spark):
    rows = spark.range(5000).select((F.pmod(F.hash("id"), F.lit(1777)) / 1777.0).alias("v"))
    ordered = sorted(r["v"] for r in rows.collect())
    for k in (0, 1, 2500, 4321, 4999):
        assert O.value_at_rank(rows, "v", lambda n: k, limit=20) == (ordered[k], 5000)
    assert O.value_at_rank(rows.where("v < 0"), "v", lambda n: 0) == (None, 0)


@pytest.mark.parametrize("limit", [1, 50, 10_000])
def test_value_at_rank_of_any_doubles(spark, limit):
    """Values that crowd one prefix, neighbours in the last bit, both signs, zeros, infinities, NaN and nulls."""
    rng = np.random.default_rng(23)
    values = np.concatenate([1 - rng.random(400) * 1e-9, rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.repeat(0.25, 70), [0.0, -0.0, 5e-324, -5e-324],
                             np.nextafter(0.25, [0, 1, 1]), [np.inf, -np.inf, np.inf, 1.7e308, -1.7e308]])
    ordered = np.sort(values).tolist() + [float("nan")] * 2
    rows = spark.createDataFrame([(None,)] + [(v,) for v in rng.permutation(ordered).tolist()], "v double")
    for k in (0, 1, 5, 150, 300, 372, 380, 420, 700, len(values) - 1, len(values), len(values) + 1):
        got, n = O.value_at_rank(rows, "v", lambda n: k, limit=limit)
        assert n == len(ordered) and (got == ordered[k] or got != got and ordered[k] != ordered[k])


def test_value_at_rank_in_two_passes(spark):
    """One histogram and one look into the crossed prefix; nothing else reads the values."""
    rows = spark.range(20_000).select((F.rand(5) * 0.5).alias("v"))
    tracker, group = spark.sparkContext.statusTracker(), "two-passes"
    spark.sparkContext.setJobGroup(group, "rank")
    ordered = None
    try:
        got = O.value_at_rank(rows, "v", lambda n: 17_000)
        assert len(tracker.getJobIdsForGroup(group)) <= 6  # AQE runs each stage of the two queries as a job
        ordered = sorted(r["v"] for r in rows.collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == (ordered[17_000], 20_000)


def test_running_totals_over_bins(spark):
    rows = spark.range(500).select((F.col("id") / 7.0).alias("v"), F.lit(1).cast("long").alias("n"), (F.col("id") % 2).alias("k"))
    out = O.running_totals(rows, "v", ["n"], by=["k"], descending=False, bins=13).orderBy("k", "v").collect()
    assert [r["cum_n"] for r in out] == list(range(1, 251)) * 2


def test_previous_value_across_spans(spark, monkeypatch):
    monkeypatch.setattr(O, "SEQ_SPAN", 4)
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(20)] + [("b", 30, "x")], "k string, seq long, v string")
    out = {(r["k"], r["seq"]): r["before"] for r in O.previous_value(rows, "k", "v").collect()}
    assert out[("a", 0)] is None and out[("b", 30)] is None
    assert all(out[("a", i)] == str(i - 1) for i in range(1, 20))
    assert [r["seq"] for r in O.last_rows(rows, 0.3).orderBy("seq").collect()] == [15, 16, 17, 18, 19, 30]


def test_rows_without_a_label_are_resampled_too(spark):
    rows = spark.createDataFrame([(str(i), None if i < 8 else "POS" if i < 20 else "NEG") for i in range(40)], "id string, label string")
    over = {r["label"]: r["count"] for r in S.oversample(rows, 1.0).groupBy("label").count().collect()}
    assert over == {None: 20, "POS": 20, "NEG": 20}
    under = {r["label"]: r["count"] for r in S.undersample(rows, 10.0).groupBy("label").count().collect()}
    assert under == {None: 8, "POS": 12, "NEG": 20}
