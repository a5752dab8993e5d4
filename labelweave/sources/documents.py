"""Large single documents read by many tasks: pieces of a file in order, and the elements of one JSON array.

A file is read by Spark's text source in pieces that end at a chosen character. A piece has a place, (file, block, pos):
the block is where the reader's split begins, and pos rises inside it. What a piece starts with (how deep in brackets, in
a string or not) follows from sums over the pieces before it: sums inside each block, and one offset per block. These sums
are taken over a few numbers per piece. Texts are read again when the sums are known, and put together in the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelweave.schema import broadcast_if_small


def read_pieces(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """(file, block, pos, value): the lines of files, or the pieces between the characters ``end``."""
    reader = spark.read if end is None else spark.read.option("lineSep", end)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("pos"), "value")


def _offsets(pieces: DataFrame, amount: str) -> DataFrame:
    """The sum of ``amount`` over all earlier blocks of the file."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col(amount).cast("long")).alias("_t")).select(
        "file", "block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"))
    return broadcast_if_small(blocks)


def _before(pieces: DataFrame, amount: str, name: str, offsets: DataFrame) -> DataFrame:
    """Adds the sum of ``amount`` over all earlier pieces of the file."""
    inside = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return (pieces.withColumn("_inside", F.coalesce(F.sum(F.col(amount).cast("long")).over(inside), F.lit(0))).join(offsets, ["file", "block"])
            .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_inside", "_offset"))


def _unescaped(text: Column) -> Column:
    """A text without its escaped characters, which stand only in strings."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)


def _outside(bare: Column, within: Column) -> Column:
    """An unescaped piece without its strings; ``within`` tells whether it starts inside one."""
    return F.array_join(F.filter(F.split(bare, "\""), lambda x, i: (i % 2 == 0) != within), " ")


def _number(text: Column, characters: str) -> Column:
    """How many of the ASCII characters stand in a text."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def _deeper(bare: Column) -> Column:
    """Brackets opened less brackets closed."""
    return _number(bare, "[{") - _number(bare, "]}")


def _in_order(place: str, text: Column) -> Column:
    """Texts of a group joined in the order of their places."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), text.alias("text")))), lambda x: x["text"]), "")


def read_elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, number, element): the objects of a JSON array as text, in order; of a document that is an object, those of the array in ``field``.

    Pieces end at closing braces, so an element is a few neighbouring pieces, found by their depth. Null, scalar and array
    elements are left out; documents that are neither an array nor an object with such a field give nothing.
    """
    pieces = read_pieces(spark, path, "}").withColumn("value", F.concat(F.ltrim("value", F.lit("\ufeff")), F.lit("}")))
    filled = F.ltrim("value", F.lit(" \t\r\n"))
    head = F.regexp_extract("value", rf'(?s)\A(.*?"{field}"\s*:\s*\[)', 1)
    behind = F.ltrim(F.expr("substring(value, char_length(_head) + 1)"), F.lit(" \t\r\n"))
    marked = pieces.withColumns({"_head": head, "_bare": _unescaped(F.col("value"))}).select(
        "file", "block", "pos", "value", (_number(F.col("_bare"), "\"") % 2).alias("_odd"), _deeper(_outside(F.col("_bare"), F.lit(False))).alias("_deeper_out"),
        _deeper(_outside(F.col("_bare"), F.lit(True))).alias("_deeper_in"), filled.startswith("[").alias("_opens"), filled.startswith("]").alias("_closes"),
        F.char_length("_head").alias("_skip"), _deeper(_outside(_unescaped(F.col("_head")), F.lit(False))).alias("_head_deeper"), behind.startswith("]").alias("_none"))
    # numbers alone, until all offsets are known
    thin, at = marked.drop("value").persist(StorageLevel.DISK_ONLY), F.struct("block", "pos")
    odd = _offsets(thin, "_odd")

    def opened(rows: DataFrame) -> DataFrame:
        return _before(rows, "_odd", "_quotes", odd).withColumn(
            "_deeper", F.when(F.col("_quotes") % 2 == 1, F.col("_deeper_in")).otherwise(F.col("_deeper_out")))

    deeper = _offsets(opened(thin), "_deeper")

    def deep(rows: DataFrame) -> DataFrame:
        return _before(opened(rows), "_deeper", "depth", deeper).withColumn("_after", F.col("depth") + F.col("_deeper"))

    placed = deep(thin)

    # where the array begins: at the document's own bracket, or behind the field's name one level down
    outer = placed.where((F.col("depth") <= 1) & (F.col("_quotes") % 2 == 0))
    listed = outer.where((F.col("depth") == 0) & F.col("_opens")).select("file", at.alias("_begin"), F.lit(1).alias("_level"), F.lit(0).alias("_from"))
    held = outer.where((F.col("_skip") > 0) & (F.col("depth") + F.col("_head_deeper") == 2)).select(
        "file", at.alias("_begin"), F.lit(2).alias("_level"), F.col("_skip").alias("_from"), "_none")
    begins = listed.withColumn("_none", F.lit(False)).unionByName(held).groupBy("file").agg(
        F.min(F.struct("_begin", "_level", "_from", "_none")).alias("_s")).select("file", "_s.*").where("not _none").drop("_none")

    # an element ends where the depth is back at the array's; a bracket first thing between elements ends the array
    begins = broadcast_if_small(begins)

    def behind_begin(rows: DataFrame) -> DataFrame:
        return rows.drop("_none").join(begins, "file").where(at >= F.col("_begin"))

    closes = behind_begin(placed).where((F.col("depth") == F.col("_level")) & (at > F.col("_begin")) & F.col("_closes"))
    ends = broadcast_if_small(closes.groupBy("file").agg(F.min(at).alias("_end")))

    def inside(rows: DataFrame) -> DataFrame:
        listed = behind_begin(deep(rows)).join(ends, "file", "left").where(F.col("_end").isNull() | (at < F.col("_end")))
        return listed.withColumns({"_from": F.when(at == F.col("_begin"), F.col("_from")).otherwise(0),
                                   "_ends": (F.col("_after") == F.col("_level")).cast("long")})

    earlier = _offsets(inside(thin), "_ends")

    def held_by(offsets: DataFrame, name: str) -> DataFrame:
        return offsets.select("file", "block", F.col("_offset").alias(name))

    # a row for each block that was read, as the driver plans one for each
    sizes = thin.groupBy("file", "block").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_pieces"))
    blocks = (sizes.join(held_by(odd, "_odd_before"), ["file", "block"]).join(held_by(deeper, "_deeper_before"), ["file", "block"]).join(held_by(earlier, "_ends_before"), ["file", "block"], "left")
              .join(begins, "file", "left").join(ends, "file", "left"))
    fixed = [F.col(f"{place}.{field}").alias(f"{place}_{field}") for place in ("_begin", "_end") for field in ("block", "pos")]
    known = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "_odd_before", "_deeper_before", F.coalesce("_ends_before", F.lit(0)).alias("_ends_before"),
                          "_first", "_pieces", "_level", "_from", *fixed)
    rows = marked.select("file", "block", "pos", "value", "_odd", "_deeper_out", "_deeper_in").join(
        F.broadcast(known), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left").drop("_file", "_block")
    whole = rows.mapInArrow(_put_together, "file string, number long, element string")

    # an element that goes over a block's end is gathered from its pieces
    pieces_of = _before(inside(thin), "_ends", "number", earlier)
    split = pieces_of.groupBy("file", "number").agg(F.min("block").alias("_a"), F.max("block").alias("_b"), F.max("_ends").alias("_whole")).where("_a < _b and _whole = 1")
    edges = pieces_of.join(broadcast_if_small(split.select("file", "number")), ["file", "number"]).select("file", "block", "pos", "number", "_from")
    several = (pieces.join(broadcast_if_small(edges), ["file", "block", "pos"]).withColumn("_at", at).groupBy("file", "number")
               .agg(_in_order("_at", F.expr("substring(value, _from + 1)")).alias("element")))
    return whole.unionByName(several).select("file", "number", F.expr("substring(element, instr(element, '{'))").alias("element"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that lie in one block, from the pieces of a task, which come block by block in order, with the sums before each block."""
    block, held, due = None, None, 0  # of the pieces before: their block; sums, number, texts of the open element, and whether it begins here; pieces to come

    def check(same: bool) -> None:
        if not same:
            raise ValueError("the splits of the files have changed since their elements were placed")

    for batch in batches:
        files, column = batch.column("file").to_pylist(), {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("file", "value")}
        new = np.flatnonzero([i == 0 or files[i] != files[i - 1] or column["block"][i] != column["block"][i - 1] for i in range(len(files))])
        found: list[tuple] = []
        for x, y in zip(new, np.append(new[1:], len(files))):
            here = {c: v[x:y] for c, v in column.items()}
            level, begin, end = here["_level"][0], *((here[f"{p}_block"][0], here[f"{p}_pos"][0]) for p in ("_begin", "_end"))
            if block != (files[x], here["block"][0]):
                block = (files[x], here["block"][0])
                check(due == 0 and here["pos"][0] == here["_first"][0])
                due = here["_pieces"][0]
                depth = int(here["_deeper_before"][0])
                held = [int(here["_odd_before"][0]), depth, int(here["_ends_before"][0]), [], depth == level and block[1] > begin[0]]
            due -= y - x
            if np.isnan(level):
                continue
            odd = here["_odd"]
            quotes = held[0] + np.cumsum(odd) - odd
            after = held[1] + np.cumsum(np.where(quotes % 2 == 1, here["_deeper_in"], here["_deeper_out"]))
            held[0], held[1] = int(quotes[-1] + odd[-1]), int(after[-1])
            inside = (here["block"] > begin[0]) | ((here["block"] == begin[0]) & (here["pos"] >= begin[1]))
            if not np.isnan(end[0]):
                inside &= (here["block"] < end[0]) | ((here["block"] == end[0]) & (here["pos"] < end[1]))
            values = batch.column("value").slice(x, y - x)
            for i in np.flatnonzero(inside).tolist():
                text = values[i].as_py()
                if here["block"][i] == begin[0] and here["pos"][i] == begin[1]:
                    text, held[4] = text[int(here["_from"][i]):], True
                if held[4]:
                    held[3].append(text)
                if after[i] == level:
                    if held[4]:
                        found.append((block[0], held[2], "".join(held[3])))
                    held[2:] = [held[2] + 1, [], True]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], names=["file", "number", "element"])
    check(due == 0)
