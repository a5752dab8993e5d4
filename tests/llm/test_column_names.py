"""Documents with columns of any name go through the operators that carry or join them."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.llm import quality, secrets
from labelweave.llm.common import read


def test_rules_are_learned_beside_columns_of_the_same_name(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    odd = docs.withColumn("label", F.lit("x")).withColumn("quality", F.lit(7)).withColumn("toxic", F.lit("y"))
    assert quality.learn(odd, labels) == quality.learn(docs, labels)
    assert quality.judge(odd, []).count() == docs.count()


def test_redaction_keeps_every_column(spark):
    rows = [(1, 'token = "0123456789abcdef0123456789abcdef01234567" here', "v", "k", 5), (2, "nothing here", "v2", "k2", 6), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _values string, _text_key string, word_no int")
    labelled = secrets.candidates(docs).withColumn("label", F.lit(1.0))
    got = {r["doc_id"]: r for r in secrets.redact(docs, labelled=labelled).collect()}
    assert got[1]["text"] == f'token = "{secrets.MASK}" here'
    assert {i: tuple(r)[2:] for i, r in got.items()} == {r[0]: r[2:] for r in rows} and got[2]["text"] == "nothing here" and got[3]["text"] is None
