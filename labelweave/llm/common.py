"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.session import scratch_path

# Fixed value: the white space between words, as the query contracts state it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows of text handed to Python code at a time; bounds what one task holds beside the Arrow batch.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame, name: str, *partition_by: str, release: bool = False) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there and a lost executor costs a re-read.

    Nothing needs the shuffle files behind a written step any more, but Spark deletes them only once the driver's JVM
    has collected what refers to them; `release` has it do so now.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write a step bucketed by a key, so that joins with as many partitions by that key leave it where it lies.

    Buckets need a table to be known; its name leaves the catalogue once the frame knows its files, which stay.
    """
    spark = df.sparkSession
    table = f"step_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the one knob by which a run is sized to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, draw: Column, max_rows: int) -> DataFrame:
    """At most `max_rows` rows, those with the smallest `draw` (a 64-bit hash).

    A threshold on the draw leaves little more than that many before anything is ordered, so the ordering task reads a
    number of rows that does not grow with the table.
    """
    n = df.count()
    scale = 1_000_000_000
    rows = df.withColumn("_draw", F.pmod(draw, F.lit(scale)))
    if n > max_rows:
        rows = rows.where(F.col("_draw") < int(scale * min(1.0, 1.2 * (max_rows + 1000) / n)) + 1)
    return rows.orderBy("_draw", *df.columns).limit(max_rows).drop("_draw")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `size` bytes of a binary column; a longer value comes alone."""
    for batch in slices(batches, rows):
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def bind(value: Column, body) -> Column:
    """Evaluate a column once per row and use it many times inside an expression."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words of a text; none for a null, empty or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
