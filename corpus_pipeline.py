"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again by the next.

Quality rules drop documents, the Jaccard join keeps one document of each group, repeated passages are removed from the
texts, secrets are masked, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import jaccard, packing, quality, secrets, suffixes
from labelweave.llm.common import read, settle, word_array

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the learned list rejects."""
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules, keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, and of these the smallest digest. Rows without words all stay.

    Rows are told apart by id and text, whatever other rows share the id; rows equal in both are linked with each other.
    The join lays the texts out by this key, so the choice among equal rows needs no further shuffle.
    """
    key, text = F.coalesce(F.col("doc_id"), F.lit(jaccard.NULL_ID)).alias("_key"), F.coalesce(F.col("text"), F.lit(""))
    found = jaccard.joined_rows(docs).where("component is not null")
    heads = found.groupBy("component").agg(F.min(F.struct(key, "content")).alias("_h")).select("_h._key", F.col("_h.content").alias("_content"))
    blank = F.size(word_array(F.col("text"))) == 0
    keyed = docs.where(~blank).select(*COLUMNS, key, F.unhex(F.sha2(text, 256)).alias("_content"))
    chosen = keyed.join(heads, ["_key", "_content"], "left_semi").groupBy("_key", "_content").agg(F.min(F.struct(*COLUMNS)).alias("_d"))
    return chosen.select("_d.*").unionByName(docs.where(blank).select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document with a smaller id."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, findings masked."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("suffix-array dedup", suffix_dedup),
          ("secret scans", secret_scan), ("packing", pack)]

ORACLE_SQL = None  # SQL states neither the learned rules and forest nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
