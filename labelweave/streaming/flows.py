"""Streams share the column functions of the batch operators.

Every sink writes a micro-batch into a folder named by its id and overwrites that folder, so a batch that is replayed
after a failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from labelweave.operators import agreement as A
from labelweave.operators import quality as Q
from labelweave.operators.resolve import resolve
from labelweave.plans.evaluation import accepted_and_rejected

# Buckets of the label table, by id, for readers that look for single ids.
BUCKETS = 16


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _put(df: DataFrame, path: str, batch: int, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch={batch}")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, once: bool = True,
                 max_chars: int = 4000) -> StreamingQuery:
    """Score accepted rows into ``out/scored``, refused ones with their reason into ``out/rejected``."""
    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        accepted, rejected = accepted_and_rejected(batch, max_chars)
        _put(score(accepted), f"{out}/scored", number)
        _put(rejected, f"{out}/rejected", number)
        batch.unpersist()

    return _start(stream, handle, f"{out}/checkpoint", once)


def check_stream(stream: DataFrame, out: str, once: bool = True, **rules) -> StreamingQuery:
    """Row-local checks: clean rows into ``out/clean``, rows with issues into ``out/quarantine``.

    Rules across rows (duplicates, splits, groups) need the whole dataset and stay with the batch operators.
    """
    marked = stream.withColumn("issues", Q.row_issues(**rules))

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _put(batch.where(F.size("issues") == 0).drop("issues"), f"{out}/clean", number)
        _put(batch.where(F.size("issues") > 0), f"{out}/quarantine", number)
        batch.unpersist()

    return _start(marked, handle, f"{out}/checkpoint", once)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")


def _sortable(df: DataFrame, column: str) -> Column:
    """Text whose order is that of row numbers, or of row places (source, file, position, part)."""
    def padded(c: Column) -> Column:
        return F.lpad(c.cast("string"), 20, "0")

    kind = df.schema[column].dataType
    if not isinstance(kind, StructType):
        return padded(F.col(column))
    inner = [F.col(f"{column}.{f.name}") for f in kind.fields]
    return F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) if isinstance(f.dataType, StringType) else padded(c) for c, f in zip(inner, kind.fields)])


_FOLDED = "id string, annotator string, label string, text string, last string, first string, last_seq string, first_seq string"
_STATE = "annotators array<string>, labels array<string>, sizes array<int>, lasts array<string>, firsts array<string>"
_INTAKE = f"kind string, {_FOLDED}, annotator_b string, label_b string, text_of string"

# State of streams that no provider is set for: on the executors' disks, in a bounded part of their memory.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ON_DISK = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}

# Rows with texts that a task of the intake hands to Python at a time.
_SLICE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _fold_slice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last row per (id, annotator) of each slice of a task's rows, with the first place, before anything is shuffled."""
    for rows in batches:
        by = ["id", "annotator"]
        early = rows.sort_values("first").drop_duplicates(by)[[*by, "first", "first_seq"]]
        late = rows.sort_values("last").drop_duplicates(by, keep="last").drop(columns=["first", "first_seq"])
        yield late.merge(early, on=by)[[f.split()[0] for f in _FOLDED.split(", ")]]


def _queue_item(key: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a micro-batch says of one id: its folded labels, and all pairs of the id that disagree after it.

    The state of the id holds the last label, the size of its text, and the first place of each annotator; a pair names the one
    whose text it takes.
    """
    held = list(zip(*state.get)) if state.exists else []
    known = {who: [label, size, last, first] for who, label, size, last, first in held}
    size_of = lambda t: None if t is None else len(t)
    fresh: dict = {}
    for rows in slices:
        for r in rows.itertuples(index=False):
            mine = fresh.get(r.annotator)
            if mine is None:
                fresh[r.annotator] = r
            else:
                late, early = (r if r.last >= mine.last else mine), (r if r.first < mine.first else mine)
                fresh[r.annotator] = late._replace(first=early.first, first_seq=early.first_seq)
    for who, r in fresh.items():
        label, size, last, first = known.get(who, (None, None, "", r.first))
        known[who] = [r.label, size_of(r.text), r.last, min(first, r.first)] if r.last >= last else [label, size, last, min(first, r.first)]
    state.update(tuple([list(c) for c in zip(*((who, *facts) for who, facts in known.items()))]))
    out = [("label", *r, None, None, None) for r in fresh.values()]
    in_order = sorted(known.items(), key=lambda x: x[1][3])
    for i, (who_a, (label_a, size_a, _, first_a)) in enumerate(in_order):
        for who_b, (label_b, size_b, _, first_b) in in_order[i + 1:]:
            if label_a is not None and label_b is not None and label_a != label_b and first_a < first_b:
                chosen = who_b if size_a is None or size_b is None or size_a < size_b else who_a
                out.append(("pair", key[0], who_a, label_a, None, None, None, None, None, who_b, label_b, chosen))
    out.append(("touched", key[0], *[None] * 10))
    names = [f.split()[0] for f in _INTAKE.split(", ")]
    for start in range(0, len(out), 10_000):
        yield pd.DataFrame(out[start:start + 10_000], columns=names, dtype=object)


def annotation_stream(stream: DataFrame, out: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last label per (id, annotator) and the pairs that disagree.

    What is known of an id is keyed state of the stream: a micro-batch reads and writes the state of its own ids, however
    many came before, and an executor that is lost takes none of it along. The folded labels of a batch go to
    ``out/labels`` (in buckets of ids), the pairs of its ids that now disagree to ``out/queue``, its ids to ``out/touched``,
    so a pair that a new label settles goes and one that it opens comes; ``current_queue`` takes each id from the last
    batch that touched it, and texts from the labels. Neither state nor queue hold texts, and where the session names no
    provider of state, it lies in RocksDB, so the state of all ids need not fit in memory.

    Rows are folded per (id, annotator) before they are shuffled. Rows without an id or annotator are their own key.
    """
    kind = stream.schema["seq"].dataType
    place, seq = _sortable(stream, "seq"), F.to_json(F.struct("seq"))
    rows = stream.select(F.col("id").cast("string").alias("id"), "annotator", "label", "text", place.alias("last"), place.alias("first"),
                         seq.alias("last_seq"), seq.alias("first_seq"))
    updates = rows.mapInPandas(_fold_slice, _FOLDED).groupBy("id").applyInPandasWithState(
        _queue_item, _INTAKE, _STATE, "update", GroupStateTimeout.NoTimeout)
    restored = StructType([StructField("seq", kind)])

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        labels = batch.where("kind = 'label'").select(
            "id", "annotator", F.from_json("first_seq", restored)["seq"].alias("first_seq"), "label", "text",
            F.from_json("last_seq", restored)["seq"].alias("seq"), _bucket(buckets))
        tasks = max(1, int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)  # that write one bucket
        _put(labels.repartition("bucket", F.pmod(F.xxhash64("id", "annotator"), F.lit(tasks))), f"{out}/labels", number, ["bucket"])
        _put(batch.where("kind = 'pair'").select("id", F.col("annotator").alias("annotator_a"), F.col("label").alias("label_a"), "annotator_b", "label_b", "text_of"),
             f"{out}/queue", number)
        _put(batch.where("kind = 'touched'").select("id"), f"{out}/touched", number)
        batch.unpersist()

    conf = stream.sparkSession.conf
    settings = _SLICE | (_ON_DISK if conf.get(_PROVIDER, None) in (None, _DEFAULT_PROVIDER) else {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return _start(updates, handle, f"{out}/checkpoint", once, "update")  # a stream has its own copy of the settings
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def current_queue(spark: SparkSession, out: str) -> DataFrame:
    """The pairs that disagree after all micro-batches: what the batch operator finds in all rows at once."""
    last = spark.read.parquet(f"{out}/touched").groupBy("id").agg(F.max("batch").alias("batch"))
    pairs = spark.read.parquet(f"{out}/queue").join(last, ["id", "batch"], "left_semi").drop("batch")
    labels = spark.read.parquet(f"{out}/labels")
    texts = labels.groupBy(F.col("id").alias("_id"), F.col("annotator").alias("_who")).agg(
        F.max_by("text", F.struct(_sortable(labels, "seq"), "batch")).alias("text"))
    mine = F.col("id").eqNullSafe(F.col("_id")) & F.col("text_of").eqNullSafe(F.col("_who"))
    return pairs.join(texts, mine, "left").select("id", "text", "annotator_a", "label_a", "annotator_b", "label_b")


def current_labels(spark: SparkSession, out: str) -> DataFrame:
    """Last label per (id, annotator) over all micro-batches."""
    rows = spark.read.parquet(f"{out}/labels")
    return A.latest_annotations(rows, keep=("text",), first="first_seq")


def current_resolution(spark: SparkSession, out: str, strategy: str = "majority") -> DataFrame:
    return resolve(spark.read.parquet(f"{out}/labels"), strategy)
