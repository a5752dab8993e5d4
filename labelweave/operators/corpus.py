"""Corpus statistics and word-piece learning."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from labelweave.functions.labels import as_column
from labelweave.operators.ordering import last_rows
from labelweave.schema import spread
from labelweave.session import scratch_path

# Words and runs of punctuation, as the pre-tokeniser cuts them.
WORD = r"(?U)\w+|[^\w\s]+"

# A symbol is wrapped in these marks, so replacing two neighbours is plain text replacement.
_OPEN, _CLOSE = "\x02", "\x03"

# Runs of symbols that the driver holds at a time, and the leading pairs it may ask for to find some.
_HELD, _WIDEST = 200_000, 1 << 18


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(WORD), F.lit(0))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _as_symbols(word: Column) -> Column:
    return F.regexp_replace(word, "(?s)(.)", f"{_OPEN}$1{_CLOSE}")


# Two neighbouring symbols; the look-ahead lets the second one be the first of the next pair.
_PAIR = f"(?s)(?<![^{_CLOSE}])(?=({_OPEN}[^{_CLOSE}]+{_CLOSE}{_OPEN}[^{_CLOSE}]+{_CLOSE})){_OPEN}"


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n) of neighbouring symbols over the word table. A pair is its two wrapped symbols, whose text order is
    the order of the symbols."""
    return (table.select("n", F.explode(F.regexp_extract_all("symbols", F.lit(_PAIR))).alias("pair"))
            .groupBy("pair").agg(F.sum("n").alias("n")))


def _wrapped(*symbols: str) -> str:
    return "".join(f"{_OPEN}{s}{_CLOSE}" for s in symbols)


def _unwrapped(word: str) -> list[str]:
    return word[1:-1].split(_CLOSE + _OPEN)


def _ranks(merges: Sequence[tuple[str, str, int]]) -> dict[tuple[str, str], list[int]]:
    """Places of each pair among the merges; a pair comes again when another merge has made one of its symbols anew."""
    found: dict[tuple[str, str], list[int]] = {}
    for i, (left, right, *_) in enumerate(merges):
        found.setdefault((left, right), []).append(i)
    return found


def merged(symbols: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """The symbols after all merges one after the other, each from left to right; only the merges that apply are visited."""
    todo = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    if not todo:
        return symbols
    heapq.heapify(todo)
    size, out = len(symbols), list(symbols)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    while todo:
        rank, i = heapq.heappop(todo)
        j = after[i]
        if out[i] is None or j >= size or rank not in ranks.get((out[i], out[j]), ()):
            continue
        out[i] += out[j]
        out[j] = None
        after[i] = after[j]
        if after[j] < size:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < size:
                later = [r for r in ranks.get((out[k], out[after[k]]), ()) if r > rank]
                if later:
                    heapq.heappush(todo, (later[0], k))
    return [s for s in out if s is not None]


def live_runs(table: DataFrame, live: set[tuple[str, str]]) -> DataFrame:
    """(n, symbols) of the longest runs of symbols whose neighbours are all ``live`` pairs, equal runs folded."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.values(), pa.int64()), pa.array(found, pa.string())], names=["n", "symbols"])

        for batch in batches:
            for n, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols, start = _unwrapped(word), 0
                for i, p in enumerate(zip(symbols, symbols[1:]), 1):
                    if p not in live:
                        if i - start > 1:
                            found[_wrapped(*symbols[start:i])] += n
                        start = i
                if len(symbols) - start > 1:
                    found[_wrapped(*symbols[start:])] += n
            if len(found) > _HELD:
                yield rows()
                found.clear()
        yield rows()

    return table.select("n", "symbols").mapInArrow(cut, "n long, symbols string").groupBy("symbols").agg(F.sum("n").alias("n"))


def merges_of_runs(runs: Sequence[tuple[int, str]], floor: int, most: int, tokens: set[str]) -> list[tuple[str, str, int]]:
    """Merges one by one, as long as the leading pair is above ``floor``, ``most`` are not reached and no token comes about twice.

    An index leads from a pair to the runs that hold it, and a merge visits only these.
    """
    counts, words, held, made = [n for n, _ in runs], [_unwrapped(r) for _, r in runs], defaultdict(list), set()
    total: Counter[tuple[str, str]] = Counter()
    for i, symbols in enumerate(words):
        for p in zip(symbols, symbols[1:]):
            total[p] += counts[i]
            held[p].append(i)
    leading = [(-n, _wrapped(*p), p) for p, n in total.items() if n > floor]
    heapq.heapify(leading)
    merges: list[tuple[str, str, int]] = []
    while leading and len(merges) < most:
        n, _, pair = heapq.heappop(leading)
        now = total.get(pair, 0)
        if now != -n:
            if now > floor:
                heapq.heappush(leading, (-now, _wrapped(*pair), pair))
            continue
        merges.append((*pair, now))
        token = pair[0] + pair[1]
        if token in tokens or token in made:
            break
        made.add(token)
        change: Counter[tuple[str, str]] = Counter()
        alone = {pair: [0]}
        for i in set(held.pop(pair)):
            was = words[i]
            words[i] = symbols = merged(was, alone)
            if symbols is was:
                continue
            for p in zip(was, was[1:]):
                change[p] -= counts[i]
            for p in zip(symbols, symbols[1:]):
                change[p] += counts[i]
                if token in p:
                    held[p].append(i)
        for p, d in change.items():
            total[p] += d
            if d > 0 and total[p] > floor:
                heapq.heappush(leading, (-total[p], _wrapped(*p), p))
    return merges


def _leading(counts: DataFrame, ranking: int, min_frequency: int) -> tuple[list[tuple[tuple[str, str], int]], int, bool]:
    """The leading pairs, the count that none beyond them exceeds, and whether these are all pairs that may be merged."""
    rows = counts.where(F.col("n") >= min_frequency).orderBy(F.col("n").desc(), "pair").limit(ranking).collect()
    complete = len(rows) < ranking
    return [(tuple(_unwrapped(r["pair"])), r["n"]) for r in rows], min_frequency - 1 if complete else rows[-1]["n"], complete


def _runs_to_hold(table: DataFrame, ranked: Sequence[tuple[tuple[str, str], int]], floor: int, most: int) -> tuple[list[tuple[int, str]] | None, int]:
    """Runs of the pairs above ``floor``, or above a higher one that leaves at most ``most`` runs; None when none does."""
    while True:
        live = {p for p, n in ranked if n > floor}
        if not live:
            return None, floor
        table = _written(live_runs(table, live))
        rows = table.limit(most + 1).collect()
        if len(rows) <= most:
            return [(r["n"], r["symbols"]) for r in rows], floor
        floor = ranked[len(live) // 2][1]


def learn_merges(df: DataFrame, num_merges: int | None = None, min_frequency: int = 2, text: str = "text", ranking: int = 4096,
                 vocab_size: int = 16_000, specials: int = 4, most: int = _HELD) -> list[tuple[str, str, int]]:
    """Byte-pair merges (left, right, frequency), most frequent pair first, the smaller pair on a tie: ``num_merges`` of them, or
    as many as fill a vocabulary of ``vocab_size`` entries, in which ``specials`` marks and the characters of words come first.

    The corpus folds to a table of distinct words once. Each round counts all pairs of the table and takes a count, the floor.
    A pair at or below it can only lose occurrences, and a pair that a merge brings about has no more than the pair it stems
    from, unless its token comes about in two ways. So until no pair is above the floor, or a token comes about twice, merges
    happen inside the runs of symbols whose neighbours are pairs above the floor. The floor is the lowest one (of ``ranking``
    pairs) that leaves at most ``most`` different runs; the driver merges in these one by one, by an index, and tasks repeat
    all merges of the round in every word. The result is that of single merges.
    """
    table = _written(spread(word_counts(df, text), "word").select("n", _as_symbols(F.col("word")).alias("symbols")))
    letters = 0
    if num_merges is None:
        letters = table.select(F.explode(F.split(F.translate("symbols", _OPEN + _CLOSE, ""), "")).alias("c")).where("c <> ''").distinct().count()
    merges: list[tuple[str, str, int]] = []
    tokens: set[str] = set()
    wide = ranking
    while True:
        left = vocab_size - specials - letters - len(tokens) if num_merges is None else num_merges - len(merges)
        if left <= 0:
            break
        counts = pair_counts(table).persist()
        ranked, floor, complete = _leading(counts, wide, min_frequency)
        while not complete and floor == ranked[0][1] and wide < _WIDEST:
            wide *= 8  # all are equally frequent: more of them
            ranked, floor, complete = _leading(counts, wide, min_frequency)
        counts.unpersist()
        if not ranked:
            break
        runs, floor = _runs_to_hold(table, ranked, floor, most)
        found = merges_of_runs(runs, floor, left, tokens) if runs else [(*ranked[0][0], ranked[0][1])]
        # the next round tries twice the pairs that could be held in this one
        wide = max(min(ranking, 16), min(ranking, 2 * sum(n > floor for _, n in ranked)))
        merges += found
        tokens.update(a + b for a, b, _ in found)
        table = _written(table, found)
    return merges


def _written(table: DataFrame, merges: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """The word table after the merges, as columns in the shared folder: it is read several times."""
    ranks = _ranks(merges)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = [_wrapped(*merged(_unwrapped(w), ranks)) for w in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words, pa.string())], names=["n", "symbols"])

    rows = table.select("n", "symbols")
    path = scratch_path(table.sparkSession, "words")
    (rows.mapInArrow(merge, "n long, symbols string") if merges else rows).write.parquet(path)
    return table.sparkSession.read.schema("n long, symbols string").parquet(path)


def merges_table(spark, merges: Sequence[tuple[str, str, int]]) -> DataFrame:
    rows = [(i + 1, a, b, a + b, int(n)) for i, (a, b, n) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string, token string, frequency long")


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters of the corpus."""
    return (df.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("char"))
            .where("char <> ''").distinct())


def vocabulary(df: DataFrame, merges: DataFrame, text: str = "text") -> DataFrame:
    """Single characters of words, and merged tokens."""
    letters = word_counts(df, text).select(F.explode(F.split("word", "")).alias("token")).where("token <> ''").distinct()
    return letters.unionByName(merges.select("token")).distinct()


def coverage(chars: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct characters, and the share of them that occurs in any token."""
    known = tokens.select(F.explode(F.split("token", "")).alias("char")).where("char <> ''").distinct()
    marked = chars.join(known.withColumn("_in", F.lit(1)), "char", "left")
    return marked.agg(F.count(F.lit(1)).alias("distinct_chars"),
                      F.coalesce(F.count("_in") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("coverage"))


def _piece_counter(merges: Sequence[tuple[str, str]]):
    ranks = _ranks(merges)

    @F.pandas_udf(LongType())
    def pieces(batch: pd.Series) -> pd.Series:
        return batch.map(lambda word: len(merged(_unwrapped(word), ranks))).astype("int64")

    return pieces


def held_out_tokens(df: DataFrame, merges: Sequence[tuple[str, str, int]], share: float = 0.05, specials: int = 2,
                    text: str = "text", key: str = "id") -> DataFrame:
    """Mean number of tokens on the last rows of the corpus, the begin and end marks included.

    Distinct words are encoded once, whatever the number of texts they occur in.
    """
    tail = last_rows(df, share)
    cut = tail.select(key, F.explode_outer(words(text)).alias("word"))
    pieces = _piece_counter(merges)
    encoded = cut.select("word").where("word is not null").distinct().withColumn("pieces", pieces(_as_symbols(F.col("word"))))
    per_text = cut.join(encoded, "word", "left").groupBy(key).agg(
        (F.coalesce(F.sum("pieces"), F.lit(0)) + specials).alias("tokens"))
    return per_text.agg(F.count(F.lit(1)).alias("held_out"), F.avg("tokens").alias("avg_tokens"))


def corpus_statistics(df: DataFrame, num_merges: int | None = None, min_frequency: int = 2, share: float = 0.05,
                      text: str = "text", key: str = "id") -> DataFrame:
    merges = learn_merges(df, num_merges, min_frequency, text)
    table = merges_table(df.sparkSession, merges)
    cover = coverage(characters(df, text), vocabulary(df, table, text))
    tail = held_out_tokens(df, merges, share, text=text, key=key)
    return cover.withColumns({"held_out": tail.select("held_out").scalar(), "avg_tokens": tail.select("avg_tokens").scalar(),
                              "merges": F.lit(len(merges))})
