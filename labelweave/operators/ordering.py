"""Order statistics without putting a whole ordering into one task.

Ranking by label or by class would give one task per label. Here an order is first cut into many bins by a rule that
depends on the row alone, bins are counted (a map-side combined aggregate), and only inside a bin are rows ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelweave.schema import broadcast_if_small, keyed_hash

# Rows of one id that are ordered together at most, as a span of row numbers.
SEQ_SPAN = 1 << 20

# Leading hex digits of the hash that name a bin.
BIN_DIGITS = 4

NOTHING, EVERYTHING = "", "g"

# Steps of an order prefix per doubling of a value, and the bins that a prefix with many values is cut into.
PREFIX_STEPS, FINE_BINS = 2048, 1 << 16

# Rows that one task orders, and bounds on the number of bins that follows from it.
ROWS_PER_BIN, MIN_BINS, MAX_BINS = 1_000_000, 8, 10_000


def hash_position(seed, *key: str) -> Column:
    """Place of a row in the seeded shuffle: hash text first, key text as tie-break."""
    return F.concat(keyed_hash(seed, *key), F.lit("|"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def hash_cuts(df: DataFrame, by: Sequence[str], seed, key: Sequence[str],
              targets: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Per bucket, the position below which exactly ``target`` rows of the seeded shuffle lie.

    ``targets`` maps the bucket size (column ``n``; ``n_min`` and ``n_max`` over all buckets are available too) to
    wanted row counts. The result has one row per bucket: ``by``, ``n``, and ``cut_<name>``; a row belongs to the
    first ``target`` rows when its position is <= the cut. Equal keys stay on one side of a cut.
    """
    rows = df.select(*by, hash_position(seed, *key).alias("_pos")).withColumn("_bin", F.substring("_pos", 1, BIN_DIGITS))
    bins = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    sizes = bins.groupBy(*by).agg(F.sum("_c").alias("n"))
    everywhere = W.partitionBy(F.lit(1))
    sizes = sizes.withColumn("n_min", F.min("n").over(everywhere)).withColumn("n_max", F.max("n").over(everywhere))
    wanted = targets(F.col("n"))
    goals = F.array(*[F.struct(F.lit(k).alias("_name"), v.cast("long").alias("_target")) for k, v in wanted.items()])
    goals = sizes.select(*by, "n", F.inline(goals))

    in_bucket = W.partitionBy(*by).orderBy("_bin") if by else W.partitionBy(F.lit(1)).orderBy("_bin")
    running = bins.withColumn("_upto", F.sum("_c").over(in_bucket))
    crossed = _join_on(running, goals, by).where((F.col("_upto") - F.col("_c") < F.col("_target"))
                                                  & (F.col("_target") <= F.col("_upto")))
    crossed = crossed.select(*by, "_bin", "_name", "_target", (F.col("_upto") - F.col("_c")).alias("_before"))

    # Only the rows of the crossed bins are ordered; copies of one key are counted first.
    # (Without buckets there is one crossed bin per target; otherwise the number of buckets is checked.)
    small = broadcast_if_small(crossed) if by else F.broadcast(crossed)
    edge = (_join_on(rows, small, [*by, "_bin"])
            .groupBy(*by, "_bin", "_name", "_target", "_before", "_pos").agg(F.count(F.lit(1)).alias("_c")))
    in_bin = W.partitionBy(*by, "_name").orderBy("_pos")
    cuts = (edge.withColumn("_upto", F.col("_before") + F.sum("_c").over(in_bin))
            .groupBy(*by, "_name")
            .agg(F.max(F.when(F.col("_upto") <= F.col("_target"), F.col("_pos"))).alias("_at"),
                 F.min("_bin").alias("_bin")))
    named = goals.join(cuts, [*by, "_name"], "left")
    cut = F.coalesce(F.col("_at"), F.col("_bin"), F.when(F.col("_target") <= 0, NOTHING).otherwise(EVERYTHING))
    return named.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == k, cut)).alias(f"cut_{k}") for k in wanted],
        *[F.max(F.when(F.col("_name") == k, F.col("_target"))).alias(f"target_{k}") for k in wanted],
    )


def _join_on(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return a.join(b, list(by))
    return a.withColumn("_all", F.lit(1)).join(b.withColumn("_all", F.lit(1)), "_all").drop("_all")


def with_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the cuts of a row's bucket; without buckets there is one row of cuts, read as constants."""
    if by:
        return df.join(broadcast_if_small(cuts), list(by))
    row = cuts.first()
    return df.withColumns({c: F.lit(row[c] if row else None).cast("string") for c in cuts.columns})


def value_bins(df: DataFrame, column: str, bins: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds ``_bin``, rising with the value, with about equal shares of ``df`` per bin.

    By default a bin holds about ROWS_PER_BIN rows.
    """
    if bins is None:
        bins = max(MIN_BINS, min(MAX_BINS, df.count() // ROWS_PER_BIN))
    shares = [i / bins for i in range(1, bins)]
    edges = sorted({float(e) for e in df.approxQuantile(column, shares, 1.0 / (4 * bins))})
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return lambda rows: rows.withColumn("_bin", F.lit(0.0))
    return lambda rows: Bucketizer(splits=splits, inputCol=column, outputCol="_bin").transform(rows)


def running_totals(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (), descending: bool = True,
                   bins: int | None = None) -> DataFrame:
    """Running sums ``cum_<value>`` over a numeric order; the rows must be distinct in (by, order)."""
    binned = value_bins(df, order, bins)(df)
    totals = binned.groupBy(*by, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    towards = F.col("_bin").desc() if descending else F.col("_bin").asc()
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(towards).rowsBetween(
        W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bin", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}")
                                           for v in values])
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*by, "_bin").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    out = binned.join(broadcast_if_small(offsets), [*by, "_bin"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.sum(v).over(inside))
    return out.drop("_bin", *[f"_o_{v}" for v in values])


def order_prefix(value: Column) -> Column:
    """A whole number that never falls where a double rises: sign and binary order of magnitude in steps of 1/2048.

    Zero is 0, infinities are outermost, and NaN is above all, as in Spark's own order.
    """
    size = F.floor(F.log2(F.abs(value)) * PREFIX_STEPS) + 1 + PREFIX_STEPS * 1100  # positive for every double but 0
    return (F.when(F.isnan(value), PREFIX_STEPS * 4000).when(value == float("inf"), PREFIX_STEPS * 3000).when(value == float("-inf"), -PREFIX_STEPS * 3000)
            .when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long"))


def value_at_rank(df: DataFrame, column: str, rank: Callable[[int], int], limit: int = ROWS_PER_BIN) -> tuple:
    """(value at 0-based ascending rank ``rank(n)``, n); (None, 0) without rows.

    Radix selection over persisted values. One pass counts the values of each prefix of the order, with their smallest and
    largest, map-side combined. The prefix that holds the rank is read again: a bin of at most ``limit`` values is folded
    and ordered, a larger one is counted again in finer, equally wide bins. The finest bin has one value.
    """
    kind = df.schema[column].dataType.simpleString()
    rows = df.select(F.col(column).cast("double").alias("v")).where(F.col(column).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bins = _bin_counts(rows, order_prefix(F.col("v")))
        n = sum(b["c"] for b in bins)
        if not n:
            return None, 0
        wanted, inside = int(rank(n)), rows
        while True:
            for at in bins:
                if wanted < at["c"]:
                    break
                wanted -= at["c"]
            low, high = at["low"], at["high"]
            if low == high or at["c"] == 1 or math.isnan(high) and math.isnan(low):
                return _as_kind(low, kind), n
            inside = inside.where((F.col("v") >= low) & (F.col("v") <= high))
            if at["c"] <= limit:
                cells = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy(F.lit(1)).orderBy("v")))
                return _as_kind(cells.where(F.col("upto") > wanted).agg(F.min("v").alias("v")).first()["v"], kind), n
            # v / 2 keeps the range finite; a bin of two neighbouring doubles is cut between them
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) if high / 2 > low / 2 else F.when(F.col("v") > low, 1.0).otherwise(0.0)
            bins = _bin_counts(inside, F.least(F.floor(share * FINE_BINS), F.lit(FINE_BINS)).cast("long"))
    finally:
        rows.unpersist()


def _bin_counts(rows: DataFrame, bin_of: Column) -> list:
    """Count, smallest and largest value of each bin that has values, in order. The number of bins does not grow with the rows."""
    bins = rows.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    return sorted(bins, key=lambda r: r["b"])


def _as_kind(value: float, kind: str):
    return int(value) if kind in ("tinyint", "smallint", "int", "bigint") else value


def seq_span(df: DataFrame, seq: str = "seq") -> Column:
    """Coarse position of a row in its source: at most SEQ_SPAN records share it."""
    kind = df.schema[seq].dataType
    if isinstance(kind, StructType):
        outer = kind.fieldNames()[:kind.fieldNames().index("pos")]
        return F.struct(*[F.col(f"{seq}.{f}").alias(f) for f in outer],
                        F.floor(F.col(f"{seq}.pos") / SEQ_SPAN).alias("pos"))
    return F.floor(F.col(seq) / SEQ_SPAN)


def previous_value(df: DataFrame, key: str, column: str, seq: str = "seq") -> DataFrame:
    """Adds ``before``: the value of the previous row with the same key.

    Rows are ordered within spans of the source order, and the last value of each span is carried to the next, so a
    key that owns a large share of the rows is still spread over many tasks.
    """
    rows = df.withColumn("_span", seq_span(df, seq))
    spans = rows.groupBy(key, "_span").agg(F.max_by(column, seq).alias("_last"))
    carried = spans.select(key, "_span", F.lag("_last").over(W.partitionBy(key).orderBy("_span")).alias("_carried"))
    inside = F.lag(column).over(W.partitionBy(key, "_span").orderBy(seq))
    return (rows.withColumn("_inside", inside).join(carried, [key, "_span"])
            .withColumn("before", F.coalesce("_inside", "_carried")).drop("_span", "_inside", "_carried"))


def last_rows(df: DataFrame, share: float, seq: str = "seq") -> DataFrame:
    """The last max(1, int(share * n)) rows in source order."""
    rows = df.withColumn("_span", seq_span(df, seq))
    spans = rows.groupBy("_span").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(F.lit(1))
    spans = (spans.withColumn("_n", F.sum("_c").over(whole))
             .withColumn("_from_end", F.sum("_c").over(whole.orderBy(F.col("_span").desc())))
             .withColumn("_want", F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
             .withColumn("_room", F.col("_want") - (F.col("_from_end") - F.col("_c")))
             .where("_room > 0").select("_span", "_c", "_room"))
    # The one span that is cut is ordered by its places alone; its rows stay where they are, and only those at the edge are counted off.
    spans = spans.persist()
    places = rows.select("_span", F.col(seq).alias("_seq")).join(broadcast_if_small(spans.where("_c > _room")), "_span")
    last = places.withColumn("_rank", F.row_number().over(W.partitionBy("_span").orderBy(F.col("_seq").desc()))).where("_rank <= _room")
    edges = (last.groupBy("_span", "_seq").agg(F.count(F.lit(1)).alias("_k")).groupBy("_span").agg(F.min(F.struct("_seq", "_k")).alias("_edge")))
    near = rows.join(broadcast_if_small(spans.join(edges, "_span", "left")), "_span")
    inner = near.where(F.col("_edge").isNull() | (F.col(seq) > F.col("_edge._seq")))
    cut = near.where(F.col(seq) == F.col("_edge._seq")).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_span").orderBy(seq))).where("_rank <= _edge._k")
    return inner.select(*df.columns).unionByName(cut.select(*df.columns))
