"""Quality rules, toxicity and secret scan: statistics against brute force, verdicts on held-out rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from labelweave.llm import quality, secrets, toxicity
from labelweave.llm.common import read

DIR = "/root/testdata/sf0.01"


def _statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(w, w[1:], w[2:]))
    seen, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    odd = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a b"), (5, "a b c a b c"), (6, "a a a a"), (6, "a a a a"), (None, "x\n\nx\nX\r\nx"), (7, "é😀 #*$%&|<> é😀"),
           (8, "w " * 20_000), (9, "\x1c b c d")]
    docs = read(spark, DIR, "documents").select("doc_id", "text").limit(300).unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumn("n_words", F.lit("clash"))
    want = collections.Counter((r.doc_id, *_statistics(r.text)) for r in docs.collect())
    out = quality.text_statistics(docs)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == want
    assert quality.text_statistics(docs.limit(0)).count() == 0
    failed = {r.doc_id: r.base_failed for r in quality.judge(docs, []).where("doc_id in (4, 8)").collect()}
    assert failed == {4: True, 8: True}


def test_rules_are_found_and_generalise(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((i, a, b, c, 0 if a > 0.8 or (b > 0.6 and c < 0.3) else 1))
    table = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, label int")
    rules = quality.fit_rules(table, ("a", "b", "c"))
    assert any(len(r) == 1 and r[0].feature == "a" and r[0].above and 0.75 < r[0].cut < 0.85 for r in rules)
    assert any({x.feature for x in r} >= {"b", "c"} for r in rules)
    judged = table.withColumn("rule", quality.verdict(rules))
    wrong = judged.where((F.col("rule").isNotNull()) != (F.col("label") == 0)).count()
    assert wrong < 60
    assert quality.fit_rules(table.where("label = 1"), ("a", "b", "c")) == []
    assert quality.fit_rules(table.limit(0), ("a", "b", "c")) == []


def test_learned_list_keeps_clean_documents(spark):
    docs, labels = read(spark, DIR, "documents"), read(spark, DIR, "labels")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    rules = quality.learn(docs, labels.where(~held))
    judged = quality.judge(docs, rules).where("not base_failed").join(labels.where(held), "doc_id")
    good = judged.where("quality = 1")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert judged.where("quality = 0 and not kept").count() >= 0.7 * judged.where("quality = 0").count()


def test_toxicity_held_out(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    scorer = toxicity.fit(docs, labels)
    assert all(any(w.rstrip("*") and "idiot scum".find(w.rstrip("*")) in at for w in scorer.lexicon) for at in ([0], [6]))
    held = scorer.score(docs.select("doc_id", "text")).join(labels.where(toxicity.held_out()), "doc_id").where("toxic is not null")
    rows = held.select("toxic", "score").collect()
    found = sum(r.toxic == 1 and r.score >= 0.5 for r in rows) / sum(r.toxic for r in rows)
    false = sum(r.toxic == 0 and r.score >= 0.5 for r in rows) / sum(r.toxic == 0 for r in rows)
    assert found > 0.85 and false < 0.01
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "You idiot, you are scum", 0.5), (3, "the of " * 40_000, 0.5)],
                                "doc_id long, text string, score double")
    scores = scorer.score(odd).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    by = {r.doc_id: r.score for r in scores}
    assert by[None] > 0.5 > by[1] == by[2]


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(i, "a text of words") for i in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(1, 30)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def texts(spark):
    odd = spark.createDataFrame([(-1, f'a token = "{SECRET}" b'), (-1, f'a token = "{SECRET}" b'), (-2, None), (-3, ""), (None, f"api_key='{SECRET[::-1]}',next"),
                                 (-4, "card 9807915762804490 paid"), (-5, "plain words " * 20_000 + f'token = "{SECRET}"'), (-6, f'token = "{SECRET}" token = "{SECRET}x9"')],
                                "doc_id long, text string")
    return read(spark, DIR, "documents").select("doc_id", "text").unionByName(odd).withColumn("value", F.lit("clash"))


def test_secret_scan(spark, texts):
    found = secrets.scan(texts).collect()
    want = collections.Counter()
    for r in texts.collect():
        for n, word in enumerate(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")):
            for part, m in enumerate(re.finditer(r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*[0-9])[A-Za-z0-9+/_=\-]{16,}", word)):
                want[(r.doc_id, n, part, m[0])] += 1
    assert collections.Counter((r.doc_id, r.word_no, r.part, r.value) for r in found) == want
    said = {(r.doc_id, r.value): r.is_secret for r in found}
    assert said[(-1, SECRET)] and said[(-5, SECRET)] and said[(None, SECRET[::-1])] and not said[(-4, "9807915762804490")]
    assert secrets.scan(texts.limit(0)).count() == 0


def test_redaction(spark, texts):
    out = secrets.redact(texts)
    assert out.columns == texts.columns and out.count() == texts.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[-1] == f'a token = "{secrets.MASK}" b' and by[-2] is None and by[-3] == "" and by[-4] == "card 9807915762804490 paid"
    assert SECRET not in by[-5] and len(by[-5]) > 200_000 and SECRET not in by[-6]
    assert out.where("doc_id = -1").count() == 2


def test_scan_with_given_labels(spark):
    rows = [(i, f"id {i:016d}abcdefgh end" if i % 2 else f"key {SECRET[i % 7:]}{i} end") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = secrets.candidates(docs).withColumn("label", (F.col("doc_id") % 2 == 0).cast("double"))
    got = secrets.scan(docs, labelled=labelled.where("doc_id < 150"))
    assert got.where(F.col("is_secret") != (F.col("doc_id") % 2 == 0)).count() == 0
