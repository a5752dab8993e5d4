"""Findings of round 4."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest

from labelweave.catalog import QUERIES
from labelweave.operators import agreement, corpus
from labelweave.operators.models import TrainConfig
from labelweave.plans import training
from labelweave.session import shared_dir
from labelweave.sources import documents
from labelweave.streaming import flows


def _once(symbols, left, right):
    out, i = [], 0
    while i < len(symbols):
        hit = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == (left, right)
        out.append(left + right if hit else symbols[i])
        i += 2 if hit else 1
    return out


def _single_merges(words, most):
    table, merges = {w: list(w) for w in words}, []
    while len(merges) < most:
        pairs = Counter()
        for w, symbols in table.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] += words[w]
        best = min((p for p, n in pairs.items() if n >= 2), key=lambda p: (-pairs[p], corpus._wrapped(*p)), default=None)
        if best is None:
            break
        merges.append((*best, pairs[best]))
        table = {w: _once(s, *best) for w, s in table.items()}
    return merges, table


@pytest.mark.parametrize("alphabet,ranking,held", [("ab", 4096, 200_000), ("abcde", 6, 40), ("abcdefghijkl", 64, 90)])
def test_all_merges_equal_single_merges(spark, alphabet, ranking, held, monkeypatch):
    """merges until no pair is left, however few pairs and runs the driver holds."""
    rng = random.Random(len(alphabet))
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(6)) for _ in range(10)]
    texts += ["aaaaaaa aaabaaab abababa"] * 2
    expected, _ = _single_merges(Counter(w for t in texts for w in t.split()), 10_000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    counted, whole = [], corpus.pair_counts
    monkeypatch.setattr(corpus, "pair_counts", lambda table: counted.append(1) or whole(table))
    assert corpus.learn_merges(df, 10_000, ranking=ranking, most=held) == expected
    assert len(counted) < len(expected)


def test_pairs_of_one_count_beyond_what_the_driver_asks_for(spark):
    """every pair of words that come twice is as frequent as any other."""
    words = [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(2)], "id long, text string")
    assert corpus.learn_merges(df, ranking=4, most=10) == [(w[0], w[1], 2) for w in words]


def test_a_vocabulary_is_filled(spark):
    """merges fill a vocabulary, in which marks and characters come first."""
    words = {"lower": 9, "lowest": 7, "newer": 6, "wider": 5, "x": 3}
    df = spark.createDataFrame([(0, " ".join(w for w, n in words.items() for _ in range(n)))], "id long, text string")
    letters = len(set("".join(words)))
    assert corpus.learn_merges(df, vocab_size=4 + letters + 5) == _single_merges(words, 5)[0]
    assert corpus.learn_merges(df, vocab_size=letters) == []


def test_merges_in_a_word_are_those_one_after_the_other():
    rng = random.Random(4)
    for _ in range(300):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(0, 12)):
            merges.append((rng.choice(tokens), rng.choice(tokens)))
            tokens.append("".join(merges[-1]))
        word = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        expected = word
        for m in merges:
            expected = _once(expected, *m)
        assert corpus.merged(word, corpus._ranks(merges)) == expected


def test_queries_learn_a_whole_vocabulary(spark, sf_dir):
    """F7, F8: before, 400 and 8 merges."""
    merges = QUERIES["bpe_vocabulary"](spark, sf_dir).count()
    assert merges > 5000
    assert QUERIES["corpus_stats"](spark, sf_dir).first()["merges"] == merges


def test_state_of_the_intake_holds_no_texts(spark, tmp_path):
    """what is known of an id lies on disk, without texts; before, every task held them in memory, once per annotator."""
    rng = random.Random(1)
    rows = [(str(i % 30), "".join(rng.choice("abcdefgh") for _ in range(2000 + n % 9)) if n % 11 else None, f"{i % 2}{n % 3}", ("POS", "NEG")[rng.randint(0, 1)], n)
            for n, i in enumerate(rng.randint(0, 60) for _ in range(400))]
    anns = spark.createDataFrame(rows, "id string, text string, annotator string, label string, seq long")
    anns.repartitionByRange(4, "seq").write.parquet(str(tmp_path / "in"))
    settings = flows._ON_DISK | flows._SLICE
    before, out = {k: spark.conf.get(k, None) for k in settings}, str(tmp_path / "out")
    query = flows.annotation_stream(spark.readStream.schema(anns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), out)
    assert {k: spark.conf.get(k, None) for k in settings} == before
    query.awaitTermination()
    operators = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert any(k.startswith("rocksdb") for k in operators[0]["customMetrics"])
    held = sum(f.stat().st_size for f in (tmp_path / "out" / "checkpoint" / "state").rglob("*.zip")) + sum(
        f.stat().st_size for f in (tmp_path / "out" / "checkpoint" / "state").rglob("*.sst"))
    assert held < 200_000 < sum(len(r[1] or "") for r in rows)
    pair = ["id", "text", "annotator_a", "label_a", "annotator_b", "label_b"]
    key = lambda r: tuple(str(x) for x in r)
    sized = agreement.disagreements(anns).select(*pair).collect()
    found = flows.current_queue(spark, out).select(*pair).collect()
    assert sorted(map(key, found)) == sorted(map(key, sized)) != []


def test_texts_of_elements_are_neither_kept_nor_shuffled(spark, tmp_path):
    """elements are put together where their file is read; before, every text was persisted and shuffled twice."""
    rng = random.Random(2)
    tasks = [{"id": i, "text": "".join(rng.choice('abc{}[]\\" é') for _ in range(rng.randint(0, 4000)))} for i in range(300)]
    text = json.dumps(tasks, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text('{"note": "\\"tasks\\": [", "tasks": ' + text + ', "more": [{"x": 1}]}', encoding="utf-8")
    disk = lambda: sum(x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before, kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), disk()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = documents.read_elements(spark, str(tmp_path), "tasks")
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a.json", "b.json"):
        mine = sorted((r["number"], r["element"]) for r in rows if r["file"].endswith(name))
        assert [n for n, _ in mine] == list(range(300)) and [json.loads(e) for _, e in mine] == tasks
    assert disk() - kept < len(text) // 2
    with pytest.raises(Exception, match="splits of the files have changed"):
        found.select("*").collect()


def test_a_sweep_leaves_no_files(spark):
    """each combination wrote vectors of all texts, and all of them stayed."""
    df = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} {i % 7}", "AB"[i % 2], ("train", "val", "test")[i % 3]) for i in range(60)],
                               "id long, text string, label string, split string")
    written = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*.parquet"))
    before = written()
    cfg = TrainConfig(ngram_min=2, ngram_max=3, min_df=1, max_iter=5)
    out = training.sweep(df, cfg, {"min_df": [1, 2], "calibrate": ["none", "odd"]}, splitter=None)
    assert sorted(r["status"][:2] for r in out.collect()) == ["fa", "fa", "ok", "ok", "ok", "ok"]
    assert written() == before
