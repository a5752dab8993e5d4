"""Column contracts shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label domain in display order, the split domain and its aliases.
LABELS = ("POS", "NEG", "NEU")
SPLITS = ("train", "val", "test")
SPLIT_ALIASES = {"valid": "val", "validation": "val"}

# Rows up to which a helper table counts as small enough to broadcast.
BROADCAST_ROWS = 100_000

# The same for a vocabulary of short strings with one number each (some 100 MB at most).
VOCABULARY_ROWS = 1_000_000


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")
    return df


def row_place(source_no: int, file: Column, pos: Column, part: Column | int = 0) -> Column:
    """Sortable place of a row: source, file, position in the file, and part of a nested record."""
    part = part if isinstance(part, Column) else F.lit(part)
    return F.struct(F.lit(source_no).alias("source"), file.alias("file"), pos.cast("long").alias("pos"),
                    part.cast("long").alias("part"))


def rename_case_insensitive(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Give the wanted columns their canonical spelling, whatever their case in the file."""
    by_lower = {c.lower(): c for c in df.columns}
    missing = [w for w in wanted if w.lower() not in by_lower]
    if missing:
        raise ValueError(f"missing required columns {missing} (any case); found {df.columns}")
    return df.withColumnsRenamed({by_lower[w.lower()]: w for w in wanted})


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; a larger table keeps an ordinary (AQE skew-aware) join.

    A small table is persisted, because the count and the join both need it.
    """
    kept = df.persist()
    if kept.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(kept)
    kept.unpersist()
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed over the session's shuffle partitions, kept apart even when the table is small.

    For work that multiplies its input, such as cutting texts into n-grams: moving a text once is far cheaper than
    what is done with it, and a later grouping on the keys needs no further shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a freshly read table that comes in fewer pieces than there are cores; a larger one stays as it is.

    Only for scans: asking an unshuffled plan for its partitions runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def keyed_hash(seed, *cols) -> Column:
    """Reproducible 128-bit draw per key as hex text: independent of partitioning and task order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_string(c) for c in cols]))


def uniform(seed, *cols) -> Column:
    """Reproducible draw in [0, 1) per key."""
    return F.conv(F.substring(keyed_hash(seed, *cols), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draw_index(n: int, seed, *cols) -> Column:
    """Reproducible 1-based index into a list of n entries."""
    return (F.conv(F.substring(keyed_hash(seed, *cols), 1, 8), 16, 10).cast("long") % n + 1).cast("int")


def _as_string(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")
