"""Train/val/test splits and resampling, reproducible and independent of partitioning.

A row's side is decided by comparing its place in a seeded shuffle with the cut of its bucket, so the rows themselves
are never sorted or shuffled: only counts, and the few rows around a cut, move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.labels import is_blank
from labelweave.operators.ordering import hash_cuts, hash_position, with_cuts
from labelweave.schema import SPLITS, broadcast_if_small, spread, uniform
from labelweave.session import scratch_path

# Groups that the greedy rule places in one job.
GROUPS_PER_BLOCK = 1 << 18

# Copies of one row that are made in one step when a class is oversampled.
COPY_BLOCK = 100_000


def check_ratios(train: float, val: float, test: float) -> None:
    if not (0 < train < 1 and 0 <= val < 1 and 0 <= test < 1):
        raise ValueError("need 0 < train < 1, 0 <= val < 1 and 0 <= test < 1")
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train + val + test must equal 1")


def language_bucket() -> Column:
    return F.lower(F.coalesce(F.col("lang"), F.lit("unk")))


def stratified_split(df: DataFrame, train: float, val: float, test: float, seed: int = 42, by_lang: bool = False,
                     key: Sequence[str] = ("id",), approx: bool = False) -> DataFrame:
    """Adds ``split``: per label, or per (label, language), int(n*train) rows, int(n*val) rows and the rest.

    ``approx`` compares the draw with the ratios alone and needs no pass over the data.
    """
    check_ratios(train, val, test)
    if approx:
        u = uniform(seed, *key)
        return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))
    rows = df.withColumn("_label", F.coalesce(F.col("label"), F.lit("")))
    by = ["_label"]
    if by_lang:
        rows, by = rows.withColumn("_lang", language_bucket()), ["_label", "_lang"]

    def targets(n):
        first = F.floor(n * F.lit(train))
        return {"train": first, "val": first + F.floor(n * F.lit(val))}

    cuts = hash_cuts(rows, by, seed, key, targets)
    cut = with_cuts(rows.withColumn("_pos", hash_position(seed, *key)), cuts, by)
    split = (F.when(F.col("_pos") <= F.col("cut_train"), "train")
             .when(F.col("_pos") <= F.col("cut_val"), "val").otherwise("test"))
    return cut.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def group_key(group: str = "group", row_id: str = "id") -> Column:
    """A row without a group is a group of its own."""
    return F.when(is_blank(group), F.concat(F.lit("__nogroup_"), F.col(row_id).cast("string"))).otherwise(F.col(group))


def group_split(df: DataFrame, train: float, val: float, test: float, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that no group crosses splits, drawing a share of the distinct groups (not of the rows).

    Groups are drawn twice: first those that leave train, then the test groups among them. A row's split follows
    from its group's two hashes and two scalars, so nothing is joined back.
    """
    check_ratios(train, val, test)
    held_out = val + test
    share = test / held_out if held_out > 0 else 0.0
    rows = df.withColumn("_group", group_key())
    groups = rows.select("_group").distinct()
    outside = hash_cuts(groups, [], seed, ["_group"], lambda n: {"out": F.ceil(n * F.lit(held_out))})
    placed = with_cuts(groups.withColumn("_pos", hash_position(seed, "_group")), outside.select("cut_out"), [])
    left = placed.where(F.col("_pos") <= F.col("cut_out")).select("_group")
    inside = hash_cuts(left, [], seed + 1, ["_group"], lambda n: {"test": F.ceil(n * F.lit(share))})

    out = with_cuts(rows, outside.select("cut_out"), [])
    # With no held-out group there is no second cut either, and the first comparison settles every row.
    out = with_cuts(out, inside.select("cut_test"), [])
    split = (F.when(hash_position(seed, "_group") > F.col("cut_out"), "train")
             .when(hash_position(seed + 1, "_group") <= F.col("cut_test"), "test").otherwise("val"))
    return out.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def group_split_or_stratified(df: DataFrame, train: float, val: float, test: float, seed: int = 42) -> DataFrame:
    """Group split when any row has a group, else the stratified split."""
    has_groups = "group" in df.columns and not df.where(~is_blank("group")).isEmpty()
    return (group_split if has_groups else stratified_split)(df, train, val, test, seed)


def group_sizes(df: DataFrame) -> DataFrame:
    """Groups by size, largest first, then by name."""
    return (df.groupBy(group_key().alias("group")).agg(F.count(F.lit(1)).alias("size"))
            .orderBy(F.col("size").desc(), "group"))


def _misses(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Sum over the buckets of how far counts are from a split's target, added up bucket by bucket."""
    total = np.zeros(counts.shape[:-1])
    for b in range(counts.shape[-1]):
        total = total + np.abs(counts[..., b] - target[b])
    return total


def greedy_sides(filled: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The split of each group, in order: that which then misses its own targets least, the first of equals.

    `filled` (split x bucket) is what the splits hold, and is updated. A choice depends on all before it, but long
    stretches go to one split: while they do, what a split holds is a running sum of counts, so a stretch is checked and
    placed at once, with a reach that doubles as long as it holds. Where splits take turns, groups are placed one by one.
    """
    sides, i, reach = np.empty(len(counts), np.int8), 0, 64
    while i < len(counts):
        part = counts[i:i + reach]
        cost = np.stack([_misses(filled[s] + part, targets[s]) for s in range(len(targets))])
        side = int(cost[:, 0].argmin())
        upto = filled[side] + np.cumsum(part, axis=0)
        cost[side] = _misses(upto, targets[side])
        other = np.flatnonzero(cost.argmin(axis=0) != side)
        stop = int(other[0]) if len(other) else len(part)
        sides[i:i + stop] = side
        filled[side] = upto[stop - 1]
        i += stop
        if stop == len(part):
            reach = min(2 * reach, 1 << 16)
        elif stop < 16:
            reach, stop = 64, min(len(counts), i + 256)
            sides[i:stop] = _one_by_one(filled, targets, counts[i:stop])
            i = stop
    return sides


def _one_by_one(filled: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> list[int]:
    held, aims, out = filled.tolist(), targets.tolist(), []
    for row in counts.tolist():
        best, side = math.inf, 0
        for s, (have, want) in enumerate(zip(held, aims)):
            cost = 0.0
            for h, c, t in zip(have, row, want):
                cost += abs(h + c - t)
            if cost < best:
                best, side = cost, s
        held[side] = [h + c for h, c in zip(held[side], row)]
        out.append(side)
    filled[:] = held
    return out


def _packed_groups(profiles: DataFrame, buckets: int) -> DataFrame:
    """(block, groups, counts): groups in order of size, then name, in blocks of at most GROUPS_PER_BLOCK, counts as packed numbers.

    A range sort, so blocks are made by many tasks; the block number rises along the order.
    """
    spark = profiles.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 4 * profiles.count() // GROUPS_PER_BLOCK)  # few groups are one block
    ordered = profiles.repartitionByRange(n, F.col("_size").desc(), "_group").sortWithinPartitions(F.col("_size").desc(), "_group")
    most = GROUPS_PER_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([names], pa.list_(pa.string())),
                                               pa.array([b"".join(held)], pa.binary())], names=["block", "groups", "counts"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                names += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy().astype("<i8").tobytes())
                size += part.num_rows
                if size + 4096 > most:
                    yield row()
                    number, names, held, size = number + 1, [], [], 0
        if size:
            yield row()

    return ordered.select("_group", F.col("counts").cast("array<bigint>")).mapInArrow(run, "block long, groups array<string>, counts binary")


def _place_block(filled: np.ndarray, targets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for groups, counts in zip(batch.column(0), batch.column(1)):
                held = filled.copy()
                sides = greedy_sides(held, targets, np.frombuffer(counts.as_py(), "<i8").reshape(-1, targets.shape[1]).astype(float))
                yield pa.RecordBatch.from_arrays([
                    pa.array([groups.as_py()], pa.list_(pa.string())), pa.array([[SPLITS[s] for s in sides.tolist()]], pa.list_(pa.string())),
                    pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["groups", "splits", "filled"])

    return run


def greedy_assignment(profiles: DataFrame, targets: np.ndarray) -> DataFrame:
    """(_group, split) of all groups of (_group, _size, counts), placed one after the other.

    The order is made by a range sort and packed to blocks. What the splits hold goes from block to block, a few numbers,
    and each block is a small job of its own that writes its part, so neither memory nor a lost executor bounds the number
    of groups.
    """
    spark = profiles.sparkSession
    path = scratch_path(spark, "groups")
    _packed_groups(profiles, targets.shape[1]).write.partitionBy("block").parquet(path)
    packed = spark.read.schema("groups array<string>, counts binary, block long").parquet(path)
    filled, parts = np.zeros_like(targets), []
    for r in packed.select("block").distinct().orderBy("block").collect():
        parts.append(scratch_path(spark, "sides"))
        (packed.where(F.col("block") == r["block"]).select("groups", "counts")
         .mapInArrow(_place_block(filled, targets), "groups array<string>, splits array<string>, filled array<double>").write.parquet(parts[-1]))
        filled = np.array(spark.read.parquet(parts[-1]).select("filled").first()["filled"]).reshape(targets.shape)
    if not parts:
        return profiles.select("_group", F.lit(SPLITS[0]).alias("split")).limit(0)
    pairs = F.explode(F.arrays_zip(F.col("groups").alias("_group"), F.col("splits").alias("split")))
    return spark.read.parquet(*parts).select(pairs.alias("p")).select("p._group", "p.split")


def group_stratified_split(df: DataFrame, train: float, val: float, test: float, seed: int = 42,
                           by_lang: bool = False) -> DataFrame:
    """Adds ``split``: whole groups, largest first, then by name, each to the split that then misses its targets least.

    Any number of groups follows the one rule. Rows never enter it: it runs over a group's counts per label (and language).
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train + val + test must equal 1")
    rows = df.withColumn("_group", group_key()).withColumn("_bucket", F.coalesce(F.col("label"), F.lit("")))
    if by_lang:
        rows = rows.withColumn("_bucket", F.concat_ws("|", "_bucket", language_bucket()))
    cells = rows.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("n")).persist()
    totals = {r["_bucket"]: r["n"] for r in cells.groupBy("_bucket").agg(F.sum("n").alias("n")).collect()}
    buckets = sorted(totals)
    targets = np.array([[totals[b] * ratio for b in buckets] for ratio in (train, val, test)], dtype=float).reshape(3, -1)
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("_bucket") == b, F.col("n"))), F.lit(0)) for b in buckets])
    profiles = cells.groupBy("_group").agg(F.sum("n").alias("_size"), counts.alias("counts"))
    assigned = greedy_assignment(profiles, targets)
    cells.unpersist()
    out = rows.join(broadcast_if_small(assigned), "_group", "left")
    return out.select(*[c for c in df.columns if c != "split"], "split")


def assign_groups(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Give rows the split of their group from a (group, split) table."""
    return df.drop("split").join(assignment.select("group", "split"), "group", "left")


def hold_out(df: DataFrame, share: float, seed: int = 42, key: Sequence[str] = ("id",)) -> DataFrame:
    """Adds boolean ``held_out``: exactly int(n * share) rows of the seeded shuffle."""
    cuts = hash_cuts(df, [], seed, key, lambda n: {"held": F.floor(n * F.lit(share))}).select("cut_held")
    return (with_cuts(df, cuts, []).withColumn("held_out", hash_position(seed, *key) <= F.col("cut_held"))
            .drop("cut_held"))


def _class_of(label: str) -> Column:
    """The class of a row; rows without a label form one of their own."""
    return F.coalesce(F.col(label).cast("string"), F.lit("\x00"))


def undersample(df: DataFrame, ratio: float = 1.0, seed: int = 42, key: Sequence[str] = ("id",),
                label: str = "label") -> DataFrame:
    """At most round(smallest class * ratio) rows per class; a target of 0 means the smallest class."""
    def targets(n):
        wanted = F.bround(F.col("n_min") * F.lit(max(0.0, ratio)))
        return {"keep": F.least(n, F.when(wanted <= 0, F.col("n_min")).otherwise(wanted))}

    rows = df.withColumn("_class", _class_of(label))
    cuts = hash_cuts(rows, ["_class"], seed, key, targets).select("_class", "cut_keep")
    return (with_cuts(rows, cuts, ["_class"]).where(hash_position(seed, *key) <= F.col("cut_keep")).select(*df.columns))


def oversample(df: DataFrame, ratio: float = 1.0, seed: int = 42, key: Sequence[str] = ("id",),
               label: str = "label") -> DataFrame:
    """Every class grows to round(largest class * max(1, ratio)) rows, never below its own size.

    Rows are repeated evenly; the remainder goes to the first rows of the seeded shuffle. ``copy`` numbers them.
    """
    def targets(n):
        wanted = F.greatest(n, F.bround(F.col("n_max") * F.lit(max(1.0, ratio))).cast("long"))
        return {"rest": wanted % n, "times": F.floor(wanted / n)}

    classed = df.withColumn("_class", _class_of(label))
    cuts = hash_cuts(classed, ["_class"], seed, key, targets).select("_class", "cut_rest", "target_times").persist()
    extra = F.when(hash_position(seed, *key) <= F.col("cut_rest"), 1).otherwise(0)
    rows = with_cuts(classed, cuts, ["_class"]).withColumn("_copies", F.col("target_times") + extra)
    # Copies are made in blocks; when a rare class needs several blocks per row, they are spread over the cluster.
    last_block = F.floor((F.col("_copies") - 1) / COPY_BLOCK)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    if (cuts.agg(F.max("target_times").alias("t")).first()["t"] or 0) >= COPY_BLOCK:
        rows = spread(rows, *key, "_block")
    first = F.col("_block") * COPY_BLOCK + 1
    last = F.least(F.col("_copies"), first + COPY_BLOCK - 1)
    return rows.select(*df.columns, F.explode(F.sequence(first, last)).alias("copy"))


def repair_splits(df: DataFrame, seed: int = 42, key: Sequence[str] = ("id",)) -> DataFrame:
    """Make train hold two classes and leave no split empty, moving single rows.

    Looks at the (split, label) counts and moves the first row, in seeded order, of what is missing.
    """
    def counts(rows):
        return {(r["split"], r["label"]): r["count"] for r in rows.groupBy("split", "label").count().collect()}

    def move(rows, wanted, target):
        pos = hash_position(seed, *key)
        first = rows.where(wanted).agg(F.min(pos).alias("p")).first()["p"]
        hit = wanted & (pos == F.lit(first))
        return rows.withColumn("split", F.when(hit, target).otherwise(F.col("split")))

    seen = counts(df)
    in_train = {l for (s, l) in seen if s == "train"}
    if len({l for (_, l) in seen}) < 2:
        raise ValueError("all splits together hold fewer than two classes")
    while len(in_train) < 2:
        source, label = min(((s, l) for (s, l) in seen if s != "train" and l not in in_train),
                            key=lambda x: (SPLITS.index(x[0]), x[1]))
        df = move(df, (F.col("split") == source) & (F.col("label") == label), "train")
        in_train.add(label)
        seen = counts(df)
    for target in ("val", "test"):
        in_target = sum(n for (s, _), n in seen.items() if s == target)
        n, label = min(((-n, l) for (s, l), n in seen.items() if s == "train"), default=(0, None))
        # The most frequent class gives a row, so train keeps its classes.
        if in_target == 0 and sum(n for (s, _), n in seen.items() if s == "train") > 1:
            df = move(df, (F.col("split") == "train") & (F.col("label") == label), target)
            seen = counts(df)
    return df
