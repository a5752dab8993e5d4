"""Character n-grams, document frequencies and TF-IDF in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from labelweave.functions.labels import as_column
from labelweave.functions.normalize import WHITESPACE_RUN
from labelweave.operators import gram_arrays as A
from labelweave.schema import VOCABULARY_ROWS, spread

DEFAULT_RANGE = (3, 5)

# Two or more white-space characters count as one blank before n-grams are cut.
SPACE_RUN = WHITESPACE_RUN.removesuffix("+") + "{2,}"


def collapse_spaces(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), SPACE_RUN, " ")


def clean_column(df: DataFrame, name: str, text: str) -> DataFrame:
    """Adds the text that n-grams are cut from, as a column that the optimiser doesn't put into a Python function's arguments:
    these may not hold higher-order functions, of which texts may be made."""
    return df.withColumn(name, F.when(F.rand(0) >= 0, collapse_spaces(text)))


def char_ngrams(text: Column | str, nmin: int = 3, nmax: int = 5) -> Column:
    """All n-grams of the text as one array, in text order per length, across word boundaries.

    A look-ahead captures n characters at every position in one linear scan; cutting substrings by position would
    rescan the text from its start for each of them.
    """
    text = as_column(text)
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).")) for n in range(nmin, nmax + 1)]))


def gram_rows(df: DataFrame, nmin: int = 3, nmax: int = 5, key: str = "id", text: str = "text") -> DataFrame:
    """(id, gram), one row per n-gram occurrence.

    The longest n-gram is cut at every position and its prefixes are the shorter ones, so the text is scanned once
    for all lengths. At the end of a text the longest one is shorter and has fewer prefixes.
    """
    longest = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{nmin},{nmax}}}))."))
    cut = df.select(key, F.explode(longest).alias("_gram"))
    size = F.length("_gram")
    prefixes = [F.when(size >= n, F.substring("_gram", 1, n)) for n in range(nmin, nmax)]
    whole = F.when(size == nmax, F.col("_gram"))
    return (cut.select(key, F.explode(F.array(*prefixes, whole)).alias("gram"))
            .where(F.col("gram").isNotNull()))


def effective_range(df: DataFrame, nmin: int, nmax: int, text: str = "text") -> tuple[int, int]:
    """The n-gram range shrunk to the longest text."""
    longest = df.agg(F.max(F.length(text)).alias("m")).first()["m"]
    if not longest:
        raise ValueError("all texts are empty")
    low = max(1, min(nmin, longest))
    return low, max(low, min(nmax, longest))


def _texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _texts): texts are partitioned by key before they are cut, so the much larger n-gram rows need no shuffle of
    their own."""
    texts = spread(df.select(key, collapse_spaces(text).alias("_text")), key)
    return texts.groupBy(key).agg(F.collect_list("_text").alias("_texts"))


def _schema(df: DataFrame, key: str, *more: StructField) -> StructType:
    return StructType([StructField(key, df.schema[key].dataType), StructField("gram", StringType()), StructField("tf", LongType()), *more])


def term_counts(df: DataFrame, nmin: int = 3, nmax: int = 5, key: str = "id", text: str = "text", known=None) -> DataFrame:
    """(id, gram, tf); with ``known``, a broadcast Arrow array, of n-grams that are not in it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, texts, owner in A.owned_texts(batch.column(1)):
                for grams, of, gram, tf in A.gram_counts(texts, nmin, nmax, owner):
                    if known is not None:
                        new = (A.places(grams, known.value) < 0)[gram]
                        of, gram, tf = of[new], gram[new], tf[new]
                    yield from A.pieces({key: batch.column(0).take(pa.array(of + start)), "gram": grams.take(pa.array(gram)), "tf": pa.array(tf)})

    return _texts_of(df, key, text).mapInArrow(count, _schema(df, key))


def ngram_counts(df: DataFrame, nmin: int = 3, nmax: int = 5, key: str = "id", text: str = "text") -> DataFrame:
    """(gram, n) over the whole corpus."""
    texts = spread(df.select(key, collapse_spaces(text).alias("_text")), key)
    return gram_rows(texts, nmin, nmax, key, "_text").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def gram_sets(df: DataFrame, nmin: int, nmax: int, text: str = "text") -> DataFrame:
    """(grams): the distinct n-grams of each text, from one scan of it."""
    texts = df.select(collapse_spaces(text).alias("_text"))
    longest = F.array_distinct(F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{nmin},{nmax}}})).")))
    prefixes = lambda n: F.transform(F.filter("_g", lambda g: F.length(g) >= n), lambda g: F.substring(g, 1, n))
    shorter = [prefixes(n) for n in range(nmin, nmax)]
    whole = F.filter(F.col("_g"), lambda g: F.length(g) == nmax)
    return texts.select(longest.alias("_g")).select(F.array_distinct(F.flatten(F.array(*shorter, whole))).alias("grams"))


def document_frequency(df: DataFrame, nmin: int = 3, nmax: int = 5, min_df: int = 1, key: str = "id",
                       text: str = "text") -> DataFrame:
    """(gram, df) for n-grams found in at least ``min_df`` texts. Tasks count slices of texts; only counts are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts, _ in A.single_texts(batch.column(0)):
                for grams, n in A.text_counts(texts, nmin, nmax):
                    yield from A.pieces({"gram": grams, "df": pa.array(n)})

    return (df.select(as_column(text).alias("_text")).mapInArrow(count, "gram string, df long")
            .groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df))


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def _held_from(vocabulary: DataFrame, limit: int) -> int:
    """The lowest document frequency from which on at most ``limit`` n-grams of the vocabulary lie."""
    held = 0
    for r in vocabulary.groupBy("df").count().orderBy(F.col("df").desc()).toLocalIterator():
        held += r["count"]
        if held > limit:
            return r["df"] + 1
    return 0


def tfidf(df: DataFrame, nmin: int = 3, nmax: int = 5, min_df: int = 1, key: str = "id", text: str = "text",
          held: int = VOCABULARY_ROWS) -> DataFrame:
    """(id, gram, tf, weight): raw count times smooth idf, scaled to length 1 per text.

    Every task looks n-grams up in a copy of the most frequent ``held`` ones. The others occur in few texts; they are joined
    with their part of the vocabulary as rows and go back to their texts as one array each, so the rows of frequent
    n-grams are never shuffled.
    """
    spark, n_docs = df.sparkSession, df.count()
    vocabulary = document_frequency(df, nmin, nmax, min_df, key, text).withColumn("idf", smooth_idf(F.lit(n_docs), F.col("df"))).persist()
    least = _held_from(vocabulary, held)
    table = vocabulary.where(F.col("df") >= least).select("gram", "idf").toArrow()
    known = spark.sparkContext.broadcast(table.column("gram").combine_chunks().cast(pa.string()))
    idf_of = spark.sparkContext.broadcast(table.column("idf").to_numpy())
    texts = _texts_of(df, key, text)
    rare = "array<struct<gram:string,tf:bigint,raw:double>>"
    if least:
        found = (term_counts(df, nmin, nmax, key, text, known).join(vocabulary.where(F.col("df") < least), "gram").groupBy(key)
                 .agg(F.collect_list(F.struct("gram", "tf", (F.col("tf") * F.col("idf")).alias("raw"))).alias("_rare")))
        same = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        texts = texts.alias("a").join(found.alias("b"), same, "left").select(f"a.{key}", "_texts", F.coalesce("_rare", F.array().cast(rare)).alias("_rare"))
    else:
        texts = texts.withColumn("_rare", F.array().cast(rare))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, asked, owner in A.owned_texts(batch.column(1)):
                mine = batch.column(2).slice(start, end - start)
                extra = mine.flatten()
                each = np.diff(mine.offsets.to_numpy())
                parts = [(extra.field("gram"), np.repeat(np.arange(end - start), each), np.arange(len(extra)), extra.field("tf").to_numpy(), extra.field("raw").to_numpy())]
                for grams, of, gram, tf in A.gram_counts(asked, nmin, nmax, owner):
                    at = A.places(grams, known.value)[gram]
                    of, gram, tf, at = of[at >= 0], gram[at >= 0], tf[at >= 0], at[at >= 0]
                    parts.append((grams, of, gram, tf, tf * idf_of.value[at]))
                norm = np.sqrt(sum(np.bincount(of, raw * raw, end - start) for _, of, _, _, raw in parts))
                for grams, of, gram, tf, raw in parts:
                    yield from A.pieces({key: batch.column(0).take(pa.array(of + start)), "gram": grams.take(pa.array(gram)), "tf": pa.array(tf),
                                         "weight": pa.array(raw / norm[of])})

    return texts.mapInArrow(weigh, _schema(df, key, StructField("weight", DoubleType())))
