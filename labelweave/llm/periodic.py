r"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended into runs.

A run is a stretch of words with smallest period q, at least `max(least_words, least_times * q)` long, that no neighbouring
word extends. By the runs theorem every run holds, at each of its periods, a Lyndon word of length q under the order of
words or under its reverse, and that word is the longest Lyndon word at its place. So

1. phase one of the suffix sorter groups the suffixes by their longest Lyndon prefix: groups are taken from the largest
   down, each hands its members' left neighbours among the suffixes not yet taken to new groups, which stand right behind
   the old ones and whose common prefix is the old one and the taken one, once per member that points there. The length
   of the prefixes is the Lyndon array, and nothing else of the sorter is needed. It runs under both orders;
2. a Lyndon word that is followed by copies of itself is extended to both sides by longest common extensions, and what is
   long enough is a run.

A run of four periods or more repeats each of its 4-word windows at distance q. So only stretches of words inside 4-word
windows that come again within a quarter of the stretch can hold a run; the others are left out before sorting, by hashes
whose collisions can only keep a stretch more. Ordinary prose keeps almost nothing, a periodic text everything.

Each document is one row, so nothing is shuffled. Defined results: null, empty and blank texts have no words and no runs;
null ids are kept; repeated rows are each on their own; texts of any length are read whole; empty tables give no rows;
only the named columns are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import sized_slices

LEAST_WORDS, LEAST_TIMES = 6, 4
WINDOW = 4  # words; a run of 4 q words, 6 at least, repeats each window of so many

_STEPS = np.random.default_rng(11).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lyndon_array(words: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by the first phase of Baier's suffix sorter.

    The end of the text is smaller than any word. Suffixes that are not yet taken form a list; when a group is taken, the
    left neighbour of a member in that list is the next suffix to the left whose group is smaller.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1])), n)
    members = [array("q", order[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]
    count = len(members)
    length = [1] * count
    below = list(range(-1, count - 1))  # the next smaller group
    above = [*range(1, count), -1]
    of, group = np.empty(n, np.int64), np.repeat(np.arange(count), np.diff(cuts))
    of[order] = group
    of = array("q", of.tobytes())
    left, right = array("q", np.arange(-1, n, dtype=np.int64).tobytes()), array("q", np.arange(1, n + 2, dtype=np.int64).tobytes())
    out = array("q", bytes(8 * n))  # left[n] and right[-1] are the list's end: they take what falls off
    top = count - 1
    while top >= 0:
        size, met, pointed, last = length[top], [], [], -1
        for i in members[top]:
            if of[i] == top:
                out[i] = size
                p, q = left[i], right[i]
                left[q] = p
                if p >= 0:
                    right[p] = q
                    if p == last:
                        pointed[-1] += 1
                    else:
                        met.append(p)
                        pointed.append(1)
                        last = p
        members[top] = None
        if met:
            moved: dict[tuple[int, int], array] = {}
            for p, times in zip(met, pointed):
                key = (times, of[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = array("q", (p,))
            for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                times, old = key
                new = len(members)
                members.append(moved[key])
                length.append(length[old] + times * size)
                after = above[old]  # `new` stands right behind its old group
                above.append(after)
                below.append(old)
                above[old] = new
                if after >= 0:
                    below[after] = new
                for p in moved[key]:
                    of[p] = new
        top = below[top]
    return np.frombuffer(out, np.int64)


def _extent(words: np.ndarray, at: int, by: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around [at, at + by) in which words `by` apart are equal, by longest common extensions of growing reach."""
    stop, step = at + by, 64
    while stop < high:
        same = words[stop:min(high, stop + step)] == words[stop - by:min(high, stop + step) - by]
        short = int(np.argmin(same)) if not same.all() else len(same)
        stop += short
        if short < len(same):
            break
        step *= 2
    start, step = at, 64
    while start > low:
        begin = max(low, start - step)
        same = words[begin:start] == words[begin + by:start + by]
        short = int(np.argmin(same[::-1])) if not same.all() else len(same)
        start -= short
        if short < len(same):
            break
        step *= 2
    return start, stop


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. `least_times` is 3 at least."""
    n, found = len(words), set()
    for order in (words, -words):
        root = lyndon_array(order)
        # the first root of a run has two more of it behind: compare a few places of them
        at = np.flatnonzero(np.arange(n) + 3 * root <= n)
        for ahead in (lambda p: 0, lambda p: p - 1, lambda p: p, lambda p: 2 * p - 1, lambda p: p // 2):
            p = root[at]
            x = at + ahead(p)
            at = at[words[x] == words[x + p]]
        done: dict[int, int] = {}  # by period, the end of the last stretch
        for i, p in zip(at.tolist(), root[at].tolist()):
            if i + p <= done.get(p, 0):
                continue
            start, stop = _extent(words, i, p, 0, n)
            done[p] = stop
            if stop - start >= max(least_words, least_times * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of words that may hold a run of LEAST_TIMES periods; none crosses a document's end."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < LEAST_WORDS:
        return none, none
    w, gram = words.astype(np.uint64), np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        gram += (w[i:n - WINDOW + 1 + i] + np.uint64(1)) * _STEPS[i]
    gram ^= gram >> np.uint64(29)
    gram += doc[:len(gram)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = doc[:len(gram)] == doc[WINDOW - 1:]
    order = np.argsort(gram, kind="stable")
    gap = np.where(gram[order][1:] == gram[order][:-1], np.diff(order), n)  # to the next place of the same window
    near = np.full(len(gram), n)
    near[order[:-1]] = gap
    near[order[1:]] = np.minimum(near[order[1:]], gap)
    near[~whole] = n
    limit, kept = np.full(n, n), -1
    while True:  # a window counts if it comes again within a quarter of its stretch
        cover = np.zeros(n + 1, np.int64)
        hit = np.flatnonzero((near < n) & (LEAST_TIMES * near <= limit[:len(near)]))
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.append(True, doc[1:] != doc[:-1])
        begin = np.flatnonzero(inside & (edge | np.append(True, ~inside[:-1])))
        end = np.flatnonzero(inside & (np.append(edge[1:], True) | np.append(~inside[1:], True))) + 1
        total = int(inside.sum())
        if total == kept:
            long = end - begin >= LEAST_WORDS
            return begin[long], end[long]
        kept = total
        limit = np.zeros(n, np.int64)
        limit[inside] = np.repeat(end - begin, end - begin)


def word_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and `collapsed`, the words that are left when of each run only its first period stays."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            texts = [t.split() for t in batch.column(1).to_pylist()]  # bytes split at the ASCII white space
            sizes = np.array([len(t) for t in texts])
            known: dict[bytes, int] = {}
            words = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
            base = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.repeat(np.arange(len(texts)), sizes)
            runs: list[list] = [[] for _ in texts]
            for x, y in zip(*(a.tolist() for a in stretches(words, doc))):
                d = int(doc[x])
                runs[d] += [(x - int(base[d]) + s, n, q) for s, n, q in runs_of(words[x:y])]
            left = []
            for t, found in zip(texts, runs):
                if found:
                    drop = np.zeros(len(t), bool)
                    for start, n, q in found:
                        drop[start + q:start + n] = True
                    t = [w for w, d in zip(t, drop.tolist()) if not d]
                left.append(b" ".join(t))
            found = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda r: (r[0], r[2]))] for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.tolist(), pa.int64()), pa.array(found, run_type), pa.array(left, pa.binary())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    out = ready.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """Of runs, that with the greatest length / period; of these that with the smallest start, then period. Null if there is none."""
    def better(a, x):
        one, two = x["length"] * a["period"], a["length"] * x["period"]
        return a.isNull() | (one > two) | ((one == two) & ((x["start"] < a["start"]) | ((x["start"] == a["start"]) & (x["period"] < a["period"]))))

    first = F.when(F.size(runs) > 0, F.get(runs, F.lit(0)))
    return F.aggregate(runs, first, lambda a, x: F.when(better(a, x), x).otherwise(a))
