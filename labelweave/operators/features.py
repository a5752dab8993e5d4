"""TF-IDF features as a relation: an index of n-grams with their columns, and sparse vectors put together by text.

The vocabulary is a table (gram, column, idf) in the shared folder. Columns are numbered by the hash bucket of a gram and its
place inside the bucket, so numbering needs one number per bucket and no ordering of the whole vocabulary. Vectors come
in two ways with equal results: texts are cut to rows, meet the index by gram, and are gathered again by text; or, when the
index is small by count, each text is looked up in a copy of it without any shuffle. Which way is taken is a matter of
the plan alone. A text that is looked up in a vocabulary is counted inside its task, and its row is written once with its vector.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, NullType, StringType, StructField, StructType, UserDefinedType

from labelweave.operators import gram_arrays as A
from labelweave.operators import ngrams as G
from labelweave.schema import BROADCAST_ROWS, VOCABULARY_ROWS
from labelweave.session import scratch_path

KINDS = ("vocabulary", "hashed")

# Hash buckets by which columns are numbered.
NUMBER_BUCKETS = 1024

# Columns up to which every task may hold a copy of the index; hashed columns are looked up by Spark ML, up to BROADCAST_ROWS.
HELD_COLUMNS = VOCABULARY_ROWS

INDEX_SCHEMA = "gram string, column int, idf double"


def bucket_of(gram: Column, num_features: int) -> Column:
    """Column of a hashed n-gram."""
    return F.pmod(F.xxhash64(gram), F.lit(num_features)).cast("int")


def numbered(grams: DataFrame) -> DataFrame:
    """Adds ``column``: 0, 1, 2, ... over all rows, by hash bucket of the gram, then by gram."""
    rows = grams.withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(NUMBER_BUCKETS)).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))  # NUMBER_BUCKETS rows
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("gram")) - 1
    return rows.withColumn("_place", place).join(F.broadcast(offsets), "_bucket").withColumn(
        "column", (F.col("_offset") + F.col("_place")).cast("int")).drop("_bucket", "_offset", "_place")


@dataclass
class GramFeatures:
    """Fitted features: the n-gram range, and the index behind ``path``."""

    path: str
    nmin: int
    nmax: int
    kind: str
    size: int
    text: str = "_norm"
    held: bool = field(default=False)

    @property
    def index(self) -> DataFrame:
        """(gram, column, idf); n-grams of one hashed column share its idf."""
        return SparkSession.active().read.schema(INDEX_SCHEMA).parquet(self.path)

    @property
    def counted(self) -> bool:
        """Whether texts are counted inside tasks, and their rows written with their vectors."""
        return self.held and self.kind == "vocabulary"

    @cached_property
    def _copy(self):
        """The n-grams and their idf in the order of columns, for every task."""
        table = self.index.orderBy("column").select("gram", "idf").toArrow()
        return SparkSession.active().sparkContext.broadcast((A.Held(table.column("gram").combine_chunks().cast(pa.string())), table.column("idf").to_numpy()))

    def _counted(self, df: DataFrame, keep: Sequence[str], made: Sequence[StructField], make, name: str) -> DataFrame:
        """The columns ``keep`` and those that ``make`` builds in the tasks from (text, column, value) of a slice of texts and their
        number, written once and read back. Entries come by text and column."""
        copy, nmin, nmax = self._copy, self.nmin, self.nmax

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, idf = copy.value
            for batch in batches:
                for start, end, texts, _ in A.single_texts(batch.column(batch.num_columns - 1), A.LOOKUP_CHARS):
                    of, column, raw = A.known_terms(texts, nmin, nmax, grams, idf)
                    order = np.argsort(of << 32 | column)
                    of, column, raw = of[order], column[order], raw[order]
                    n = end - start
                    values = raw / np.sqrt(np.bincount(of, raw * raw, n))[of]
                    mine = batch.slice(start, n)
                    yield pa.RecordBatch.from_arrays([*mine.columns[:-1], *make(of, column, values, n)], names=[*mine.schema.names[:-1], *names])

        names = [f.name for f in made]
        fields = [df.schema[c] for c in keep]
        void = [f.name for f in fields if isinstance(f.dataType, NullType)]  # files have no such type
        kinds = [*[StringType() if f.name in void else f.dataType for f in fields], *[f.dataType for f in made]]
        plain = [k.sqlType() if isinstance(k, UserDefinedType) else k for k in kinds]
        rows = df.withColumns({c: F.col(c).cast("string") for c in void}).select(*keep, F.col(self.text).alias("_asked"))
        every = [*keep, *names]
        ran = rows.mapInArrow(run, StructType([StructField(c, k) for c, k in zip(every, plain)]))
        return _reread(ran, name, StructType([StructField(c, k) for c, k in zip(every, kinds)])).withColumns({c: F.lit(None) for c in void})

    def _vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        size = self.size

        def vectors(of: np.ndarray, column: np.ndarray, values: np.ndarray, n: int) -> list[pa.Array]:
            return [pa.StructArray.from_arrays([
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                A.lists(of, n, pa.array(column.astype(np.int32)), pa.list_(pa.int32()), True),
                A.lists(of, n, pa.array(values), pa.list_(pa.float64()), True)], names=["type", "size", "indices", "values"])]

        return self._counted(df, keep, [StructField("features", VectorUDT())], vectors, "vectors")

    def scores(self, df: DataFrame, heads: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """The rows of ``counted`` features with ``_l0``, ``_p0``, ``_l1``, ...: of each linear head, given by its coefficients (classes x
        columns) and intercepts, the class scores and their softmax. Vectors never leave their task."""
        copy = SparkSession.active().sparkContext.broadcast([(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in heads])

        def score(of: np.ndarray, column: np.ndarray, values: np.ndarray, n: int) -> list[pa.Array]:
            out = []
            for weights, intercepts in copy.value:
                raw = np.column_stack([b + np.bincount(of, values * w[column], n) for w, b in zip(weights, intercepts)])
                share = np.exp(raw - raw.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                row = np.repeat(np.arange(n), raw.shape[1])
                out += [A.lists(row, n, pa.array(v.ravel()), pa.list_(pa.float64()), True) for v in (raw, share)]
            return out

        made = [StructField(f"_{c}{i}", ArrayType(DoubleType())) for i in range(len(heads)) for c in "lp"]
        return self._counted(df, df.columns, made, score, "scores")

    @cached_property
    def _lookup(self) -> PipelineModel:
        """The index of hashed columns as a pipeline of narrow stages; only for one that is small by count."""
        names, inverse = [str(i) for i in range(self.size)], [0.0] * self.size
        for r in self.index.groupBy("column").agg(F.max("idf").alias("idf")).collect():
            inverse[r["column"]] = r["idf"]
        parts = ", ".join(f"regexp_extract_all(_clean, '(?s)(?=(.{{{n}}})).', 1)" for n in range(self.nmin, self.nmax + 1))
        run = G.SPACE_RUN.replace("\\", "\\\\")
        cut = f"transform(flatten(array({parts})), g -> cast(pmod(xxhash64(g), {self.size}L) AS string))"
        return PipelineModel([
            SQLTransformer(statement=f"SELECT *, regexp_replace({self.text}, '{run}', ' ') AS _clean FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, {cut} AS _grams FROM __THIS__"),
            CountVectorizerModel.from_vocabulary(names, inputCol="_grams", outputCol="_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(inverse), inputCol="_tf", outputCol="_raw"),
            Normalizer(p=2.0, inputCol="_raw", outputCol="features")])

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """The rows, or their columns ``keep``, with ``features``: tf * idf, scaled to length 1; a text without a known n-gram has
        an empty vector."""
        keep = list(keep or df.columns)
        if self.counted:
            return self._vectors(df, keep)
        if keep != df.columns:
            return self.transform(df).select(*keep, "features")
        if self.held:
            return self._lookup.transform(df).drop("_clean", "_grams", "_tf", "_raw")
        rows = df.withColumn("_text_key", text_key(self.text))
        texts = rows.select("_text_key", self.text).dropDuplicates(["_text_key"])
        found = self.vectors(G.term_counts(texts, self.nmin, self.nmax, "_text_key", self.text), "_text_key")
        empty = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"), F.array().cast("array<int>").alias("indices"),
                         F.array().cast("array<double>").alias("values"))
        every = rows.select("_text_key").distinct().join(found, "_text_key", "left").select("_text_key", F.coalesce("features", empty).alias("features"))
        return rows.join(as_vectors(every, "features"), "_text_key").drop("_text_key")

    def vectors(self, terms: DataFrame, key: str) -> DataFrame:
        """(key, features) from (key, gram, tf), features in the layout of sparse vectors. Nothing here depends on the driver."""
        if self.kind == "hashed":
            weights = self.index.groupBy("column").agg(F.max("idf").alias("idf"))  # at most `size` rows
            counted = terms.groupBy(key, bucket_of(F.col("gram"), self.size).alias("column")).agg(F.sum("tf").alias("tf"))
            found = counted.join(weights, "column")
        else:
            found = terms.join(self.index, "gram")
        values = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column", (F.col("tf") * F.col("idf")).alias("v")))).alias("_e"))
        length = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["v"] * e["v"]))
        # the length stands in an array of one struct, so that it is computed once per text and not once per entry
        made = F.transform(F.array(F.struct(F.col("_e").alias("e"), length.alias("n"))), lambda s: F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"), F.transform(s["e"], lambda e: e["column"]).alias("indices"),
            F.transform(s["e"], lambda e: e["v"] / s["n"]).alias("values")))
        return values.select(key, F.get(made, F.lit(0)).alias("features"))

    def gram_lengths(self) -> tuple[int, int]:
        """Length of the shortest and of the longest n-gram of the index."""
        r = self.index.agg(F.min(F.length("gram")).alias("a"), F.max(F.length("gram")).alias("b")).first()
        return (r["a"] or 1, r["b"] or 1)

    def save(self, path: str) -> None:
        self.index.write.mode("overwrite").parquet(f"{path}/index")
        meta = json.dumps({"nmin": self.nmin, "nmax": self.nmax, "kind": self.kind, "size": self.size, "text": self.text, "held": self.held})
        SparkSession.active().createDataFrame([(meta,)], StructType([StructField("value", StringType())])).coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> GramFeatures:
        return cls(f"{path}/index", **json.loads(SparkSession.active().read.text(f"{path}/meta").first()["value"]))


def text_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def as_vectors(df: DataFrame, column: str) -> DataFrame:
    """The rows with a struct column turned to Spark's vector type: written once and read back under that type."""
    return _reread(df, "vectors", StructType([StructField(f.name, VectorUDT()) if f.name == column else f for f in df.schema.fields]))


def _reread(df: DataFrame, name: str, schema: StructType) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def fit_features(train: DataFrame, nmin: int, nmax: int, min_df: int, kind: str = "vocabulary", num_features: int = 1 << 18,
                 text: str = "_norm") -> GramFeatures:
    """Features fitted on the training texts.

    Range and min_df shrink for tiny data; an empty vocabulary falls back to n-grams of length 1 to 3 without a
    frequency floor. What the features are is the caller's word and never depends on the size of the vocabulary:

    * ``vocabulary``: one column per n-gram found in at least ``min_df`` texts.
    * ``hashed``: ``num_features`` columns. An n-gram below the floor weighs nothing unless it shares its column with
      one above it; the kept n-grams keep their names, so weights and explanations work as for a vocabulary.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown features {kind!r}")
    spark, n_docs = train.sparkSession, train.count()
    if n_docs == 0:
        raise ValueError("empty training split")
    nmin, nmax = G.effective_range(train, nmin, nmax, text)
    path = scratch_path(spark, "gram-index")
    size = _write_index(train, nmin, nmax, min(min_df, n_docs), n_docs, kind, num_features, text, path)
    if not size:
        longest = train.agg(F.max(F.length(text)).alias("m")).first()["m"]
        nmin, nmax, path = 1, min(3, longest), scratch_path(spark, "gram-index")
        size = _write_index(train, nmin, nmax, 1, n_docs, kind, num_features, text, path)
    columns = num_features if kind == "hashed" else size
    return GramFeatures(path, nmin, nmax, kind, columns, text, held=columns <= (min(HELD_COLUMNS, BROADCAST_ROWS) if kind == "hashed" else HELD_COLUMNS))


def _write_index(train: DataFrame, nmin: int, nmax: int, min_df: int, n_docs: int, kind: str, num_features: int, text: str, path: str) -> int:
    """Writes the index; returns the number of its n-grams."""
    frequent = G.document_frequency(train, nmin, nmax, 1 if kind == "hashed" else min_df, text=text)
    idf = lambda df: F.log(F.lit(1.0 + n_docs) / (1 + df)) + 1.0
    if kind == "hashed":
        # a column counts a text once however many of its n-grams the text holds
        kept = frequent.where(F.col("df") >= min_df).withColumn("column", bucket_of(F.col("gram"), num_features))
        held = G.gram_sets(train, nmin, nmax, text).select(F.explode(F.array_distinct(F.transform("grams", lambda g: bucket_of(g, num_features)))).alias("column"))
        counts = held.groupBy("column").agg(F.count(F.lit(1)).alias("n"))  # at most num_features rows
        index = kept.select("gram", "column").join(counts, "column").select("gram", "column", idf(F.col("n")).alias("idf"))
    else:
        frequent = _reread(frequent, "frequencies", StructType(frequent.schema.fields))  # numbering reads them twice
        index = numbered(frequent).select("gram", "column", idf(F.col("df")).alias("idf"))
    index.write.parquet(path)
    return train.sparkSession.read.schema(INDEX_SCHEMA).parquet(path).count()


def coefficient_table(spark: SparkSession, matrix) -> DataFrame:
    """(column, w) of a fitted coefficient matrix (classes x columns), which the driver holds anyway."""
    import numpy as np
    import pyarrow as pa

    flat = np.ascontiguousarray(matrix.T, np.float64)
    offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
    return spark.createDataFrame(pa.table({"column": pa.array(np.arange(len(flat), dtype=np.int32)), "w": lists}))
