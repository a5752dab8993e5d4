"""Jaccard join, suffix dedup and NN-descent against brute force."""

import collections
import datetime
import decimal
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import components, jaccard, neighbours, suffixes
from labelweave.llm.common import read, settle_by

LOW = -(1 << 63)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def least(self, ids):
        best = {}
        for i, k in enumerate(ids):
            best[self.root(i)] = min(best.get(self.root(i), k), k)
        return [best[self.root(i)] for i in range(len(ids))]


def _copies(rng, groups):
    words, out, number = [f"w{i}" for i in range(400)], [], 8_000_000
    for _ in range(groups):
        n = rng.choice([6, 9, 14, 25, 60, 150])
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.choice([2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3]) * max(1, n // 60)):
                copy[rng.randrange(n)] = rng.choice(words)
            out.append((number, " ".join(copy[:-1] if rng.random() < 0.3 else copy)))
            number += 1
    return out


def test_jaccard_components(spark, sf_dir):
    odd = [(-1, "A b"), (-2, "a  B"), (-3, None), (-4, " \n"), (None, "one two three four five six"), (7_000_000, "one two three four five six"),
           (7_000_001, "x y"), (7_000_001, "p q r"), (7_000_002, "p q r"), (7_000_003, "É b c d e"), (7_000_004, "é b c d e"),
           (7_000_005, "z" * 40_000 + " b"), (7_000_006, "z" * 40_000 + " b")]
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame(odd + _copies(random.Random(3), 25), "doc_id long, text string")).withColumn("row", F.lit("clash"))
    rows = docs.collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = [], collections.defaultdict(list)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(fold))
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])))
        for s in sets[-1]:
            holders[s].append(len(sets) - 1)
    union, links = Union(len(rows)), 0
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                union.up[union.root(i)] = union.root(j)
                links += 1
    least = union.least([LOW if r.doc_id is None else r.doc_id for r in rows])
    want = collections.Counter((r.doc_id, len(s), None if c == LOW else c) for r, s, c in zip(rows, sets, least))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert links > 500 and got == want


def test_sketches_of_different_widths_fold():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (300, 700, 900, 1500, 5000)]
    sets += [np.unique(np.concatenate([sets[3][:1450], sets[4][:60]])), sets[4][:4500]]
    wide = jaccard.WideSketches([jaccard.wide_sketch(s) for s in sets])
    assert wide.bits.tolist() == [0, 2048, 2048, 4096, 16384, 4096, 16384]
    for i in range(1, len(sets)):
        js = np.array([j for j in range(len(sets)) if j != i])
        close = wide.close(i, js, np.array([len(sets[j]) for j in js]) + len(sets[i]))
        for j, ok in zip(js.tolist(), close.tolist()):
            shared = len(np.intersect1d(sets[i], sets[j]))
            linked = 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared)
            assert ok or not linked
            if j and 1 < min(len(sets[i]), len(sets[j])) / max(len(sets[i]), len(sets[j])) * 2 and not linked:
                assert not ok


def test_a_passage_of_many_long_documents_makes_no_pairs(spark, monkeypatch):
    """A third of the documents are long and share a passage and little else: no pair of them is compared, and near copies still link."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    long = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1200, 1500)))
    rows = [(i, f"{passage} {long()}" if i % 3 == 0 else f"{rng.random()} {rng.random()} a b c d {rng.random()}") for i in range(240)]
    rows.append((1000, rows[3][1] + " and some more words"))
    compared, compare = [], jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda pairs, texts: compared.append(pairs.count()) or compare(pairs, texts))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 1000 else i for i, _ in rows}
    assert sum(compared) < 2 * len(rows)


def test_jaccard_on_no_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_ignore_block_ends(monkeypatch):
    text = b" ".join(b"Word%d" % i for i in range(3000)) + b" " + b"x" * 500
    whole = jaccard.shingle_set(text)
    jaccard._tables.clear()
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    assert np.array_equal(whole, jaccard.shingle_set(text.lower()))
    jaccard._tables.clear()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    union = Union(300)
    for a, b in links:
        union.up[union.root(a)] = union.root(b)
    least = union.least(range(300))
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: least[x] for x in touched}


PASSAGE = "The quick brown fox jumps over the lazy dog while 17 cats look on from a wall."


def test_remove_repeats(spark, sf_dir):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    odd = [(-1, base), (5_000_001, base[100:170] + "zz" + base[1000:1049] + "q" + base[1000:1050]), (5_000_002, base[101:171]), (5_000_003, None),
           (None, base[:60]), (5_000_004, "x" * 200), (5_000_005, "x" * 49), (5_000_006, "x" * 51), (5_000_004, base), (5_000_007, base + base),
           (5_000_007, base + base), (5_000_008, "ab" * 1000), (5_000_009, "ba" * 30 + "é" * 40), (5_000_010, ""), (5_000_011, base * 250)]
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = sorted(((LOW if r.doc_id is None else r.doc_id), (r.text or "").encode()) for r in docs.collect())
    first = {}
    for i, b in rows:
        for s in range(len(b) - 49):
            first.setdefault(b[s:s + 50], i)
    want = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter((LOW if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                              for r in suffixes.remove_repeats(docs.withColumn("batch", F.lit(1))).collect())
    assert sum(k[2] for k in want) > 50_000 and got == want
    spread = suffixes.remove_repeats(docs, hot=1)  # all open contexts by the way of hot anchors
    assert got == collections.Counter((LOW if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in spread.collect())
    whole = suffixes.without_repeats(docs.withColumn("batch", F.lit("clash")))
    assert whole.columns == ["doc_id", "text", "batch"]
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in whole.where("doc_id <> 5000009 or doc_id is null").collect()) == sorted(
        h for (i, *_, h), n in want.items() if i != 5_000_009 for _ in range(n))
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_without_repeats_keeps_columns_and_types(spark):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, "p" * 10 + PASSAGE, when, [1, None], None, b"\x00\xff", decimal.Decimal("1.50")), (2, PASSAGE + " q", None, None, "x", None, None),
            (None, None, when, [], "", b"", None), (3, "", when, [3], "y", b"z", decimal.Decimal("0.01"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, home timestamp, carried array<int>, ids string, blob binary, kept decimal(9,2)")
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    keyed = {r.doc_id: r for r in got.collect()}
    assert {i: tuple(r)[2:] for i, r in keyed.items()} == {r[0]: r[2:] for r in rows}
    assert [keyed[i].text for i in (1, 2, 3, None)] == ["p" * 10 + PASSAGE, " q", "", ""]
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


def test_texts_are_shuffled_nowhere(spark, sf_dir):
    """Packed texts lie bucketed by home, so the joins with their answers exchange only the answers."""
    packed = settle_by(suffixes.pack_texts(read(spark, sf_dir, "documents")), "packed", "home", 3)
    answers = spark.range(5).select(F.col("id").alias("home"), F.col("id").alias("batch"), F.lit(1).alias("flags"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffixes._to_home(packed, answers, ["home", "batch", "flags"], 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


@pytest.mark.parametrize("shallow", [0, 8, 16, 32, 48])
def test_deep_shallow_sorts_suffixes(shallow):
    rng = random.Random(shallow)
    data = np.frombuffer(bytes(rng.choice(b"ab\x00\xff") for _ in range(200)) * 4 + b"c" * 80, np.uint8)
    starts = np.arange(0, len(data) - 50, 3)
    order, group = suffixes.deep_shallow(data, starts, 50, shallow)
    texts = [data[s:s + 50].tobytes() for s in starts[order]]
    assert texts == sorted(texts) and sorted(order) == list(range(len(starts)))
    assert all((x == y) == (g == h) for x, y, g, h in zip(texts, texts[1:], group, group[1:]))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    a, b, shared = (rng.integers(97, 105, n).astype(np.uint8) for n in (300, 500, 120))
    data = np.concatenate([a, shared, b, shared])
    first, count, anchor, _ = suffixes.anchors(data, np.full(len(data), len(data)))
    of = {int(s): int(h) for f, n, h in zip(first, count, anchor) for s in range(f, f + n)}
    assert set(of) == set(range(len(data) - 49))
    assert [of[300 + i] for i in range(71)] == [of[920 + i] for i in range(71)]


def test_near_vectors(spark, sf_dir):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    odd = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [None] + [1.0] * 63), (-5, []), (None, [1.0] * 64), (9_000_000, [1.0] * 64),
           (9_000_001, [2.0] * 64), (9_000_001, [2.0] * 64), (9_000_002, [1.0, 2.0]), (9_000_003, [2.0, 4.0]), (-6, [float("inf")] + [0.0] * 63)]
    odd += [(9_100_000 + i, [float(z) for z in centre + rng.standard_normal(64) * s]) for i, s in enumerate([0.05] * 60 + [0.15] * 60 + [0.25] * 40)]
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(
        spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("node", F.lit("clash"))
    rows = vectors.collect()
    good = [i for i, r in enumerate(rows) if r.embedding and all(z is not None and math.isfinite(z) for z in r.embedding) and any(r.embedding)]
    links, union = [0] * len(rows), Union(len(rows))
    for size in (2, 64):
        at = [i for i in good if len(rows[i].embedding) == size]
        x = np.array([rows[i].embedding for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.95)):
            if a != b:
                links[at[a]] += 1
                union.up[union.root(at[a])] = union.root(at[b])
    ids = [LOW if r.vec_id is None else r.vec_id for r in rows]
    least = union.least(ids)
    want = collections.Counter((r.vec_id, n, None if c == LOW else c, c == k) for r, n, c, k in zip(rows, links, least, ids))
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(vectors).collect())
    assert sum(links) > 10_000 and got == want
    assert neighbours.near_duplicates(vectors.limit(0)).count() == 0
