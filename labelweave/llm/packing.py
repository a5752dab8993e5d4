"""Packing along a space-filling curve.

Documents are tokenised and their token counts hashed into a signed vector, which is projected to three dimensions;
its cell's Hilbert index is the sort key. A range sort by (key, row) lays the documents along the curve, running token
totals give each document its place on one long tape, and the tape is cut every `length` tokens. The tail is cut into
powers of two, so nothing is padded.

Only (row, key, count) is sorted; the ids travel once, to meet their place. A hot key is split by the row number, so
copies do not gather in one task. Per-partition totals (one number per partition) come to the driver.

Defined results: null text is an empty document of one id (the end id); null doc ids are kept; repeated rows are packed
each on its own; a text of any length is tokenised in blocks that end at white space; an empty table gives no pieces;
only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import settle, shuffle_width, sized_slices, slices

DIMENSIONS, BITS, BUCKETS = 3, 10, 64
CACHED_WORDS = 200_000
BLOCK = 1 << 20

# Fixed value: separators that Python splits at but the tokenizer's pattern does not take for white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!#$%&()*+,\-./:;=?@\[\]^`{|}~\"]*)\Z")


class WordIds:
    """Ids of whole texts by a tokenizer whose pieces never span white space, with a bounded cache of seen words.

    New plain words are encoded together in one call: each ends with exactly one id whose piece carries the word end.
    Any other string between white space is encoded on its own, by the same tokenizer.
    """

    def __init__(self, path: str, dtype) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.joined = bool(suffix)
        # two generations each: what is met again in the older one moves to the newer one
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_plain: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _age(self) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.plain) > CACHED_WORDS:
            self.plain, self.old_plain = {}, self.plain

    def _learn(self, chunks: Iterable[str]) -> None:
        words, old, match, split = self.words, self.old_words, _PLAIN.match, []
        for chunk in chunks:
            if (seen := old.get(chunk)) is not None:
                words[chunk] = seen
            elif self.joined and chunk.isascii() and chunk.isalpha():
                split.append((chunk, chunk.lower(), ""))
            elif not self.joined or (m := match(chunk)) is None:
                words[chunk] = self._encode(chunk)
            else:
                split.append((chunk, m[1].lower(), m[2]))
        plain, old, new = self.plain, self.old_plain, []
        for w in {x[1] for x in split}.union(x[2] for x in split).difference(plain):
            if (seen := old.get(w, None if w else b"")) is not None:
                plain[w] = seen
            else:
                new.append(w)
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                size, whole = ids.itemsize, ids.tobytes()
                stops = (stops * size).tolist()
                plain.update((w, whole[a:b]) for w, a, b in zip(part, [0, *stops[:-1]], stops))
            else:
                plain.update((w, self._encode(w)) for w in part)
        for chunk, word, mark in split:
            words[chunk] = plain[word] + plain[mark] if mark else plain[word]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts; the words that are new to all of them are learned together."""
        out: list = [None] * len(texts)
        cut = {i: t.split() for i, t in enumerate(texts) if len(t) <= BLOCK and not _ODD_SPACE.search(t)}
        self._age()
        self._learn(set(chain.from_iterable(cut.values())).difference(self.words))
        get = self.words.__getitem__
        for i, chunks in cut.items():
            out[i] = b"".join(map(get, chunks))
        return [self.ids(t) if o is None else o for t, o in zip(texts, out)]

    def ids(self, text: str) -> bytes:
        out, start = [], 0
        while start < len(text):
            end = start + BLOCK
            while end < len(text) and not text[end].isspace():
                end += 1
            block, start = text[start:end], end
            if _ODD_SPACE.search(block):
                out.append(self._encode(block))
                continue
            chunks = block.split()
            self._age()
            self._learn([c for c in set(chunks) if c not in self.words])
            out.append(b"".join(map(self.words.__getitem__, chunks)))
        return b"".join(out)


_held: dict = {}


def word_ids(path: str, dtype: str) -> WordIds:
    """The encoder of a path, one per process, so that tasks share what their worker has learned."""
    if (path, dtype) not in _held:
        _held[path, dtype] = WordIds(path, np.dtype(dtype))
    return _held[path, dtype]


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows x dimensions), by the transposed-axes construction."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as id arrays: hashed signed counts, projected, squashed to cells."""
    lengths = np.array([len(a) for a in ids])
    flat = np.concatenate(ids).astype(np.uint64) if lengths.sum() else np.zeros(0, np.uint64)
    mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(58)).astype(np.int64)
    sign = np.where((mixed >> np.uint64(57)) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(len(ids)), lengths)
    vectors = np.bincount(row * BUCKETS + bucket, sign, len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    plane = np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS))
    return hilbert_index(np.minimum((0.5 + 0.5 * np.tanh(vectors @ plane)) * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end_id: int, dtype: str, text: str = "text") -> DataFrame:
    """(row, doc_id, n, key, ids): ids as packed little-endian numbers, the end id last."""
    ready = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(path, dtype), np.array([end_id], dtype).tobytes()
        for batch in sized_slices(batches, 2, rows=1024):
            ids = [i + end for i in encoder.batch(batch.column(2).to_pylist())]
            keys = curve_keys([np.frombuffer(i, dtype) for i in ids])
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "doc_id": batch.column(1),
                                              "n": pa.array([len(i) // np.dtype(dtype).itemsize for i in ids], pa.int64()),
                                              "key": pa.array(keys, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return ready.mapInArrow(run, "row long, doc_id long, n long, key long, ids binary")


def places(tokens: DataFrame) -> DataFrame:
    """(row, start): where each document begins on the tape, in curve order."""
    spark = tokens.sparkSession
    ranged = (tokens.select("row", "key", "n").repartitionByRange(shuffle_width(spark), "key", "row")
              .sortWithinPartitions("key", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            stops = total + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "part": pa.array(np.full(len(n), part, np.int32)),
                                              "begin": pa.array(stops - n), "stop": pa.array(stops)})
            total = int(stops[-1]) if len(n) else total

    local = settle(ranged.mapInArrow(run, "row long, part int, begin long, stop long"), "tape")
    totals = sorted((r["part"], r["total"]) for r in local.groupBy("part").agg(F.max("stop").alias("total")).collect())
    offsets, at = [], 0
    for part, total in totals:
        offsets.append((part, at))
        at += total
    table = spark.createDataFrame(offsets, "part int, base long")
    return local.join(F.broadcast(table), "part").select("row", (F.col("base") + F.col("begin")).alias("tape_start"), F.lit(at).alias("tape_length"))


def cut_pieces(begin: int, n: int, tape: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence_id, offset) of the pieces of a document that lies at `begin` on the tape."""
    out, at, end, full = [], begin, begin + n, tape // length
    while at < end:
        sequence, first = at // length, at // length * length
        size = length
        if sequence >= full:  # the tail: powers of two, largest first
            sequence, first, left = full, full * length, tape - full * length
            while True:
                size = 1 << (left.bit_length() - 1)
                if at < first + size:
                    break
                first, left, sequence = first + size, left - size, sequence + 1
        stop = min(end, first + size)
        out.append((at - begin, stop - at, sequence, at - first))
        at = stop
    return out


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, text: str = "text") -> DataFrame:
    """One row per piece, with its ids: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset."""
    from tokenizers import Tokenizer

    largest = max(end_id, max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()))
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    tokens = settle(tokenized(docs, path, end_id, dtype, text), "tokens")
    placed = tokens.select("row", "doc_id", "n", "ids").join(places(tokens), "row").select("doc_id", "n", "ids", "tape_start", "tape_length")
    names = ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[] for _ in names]
            for doc_id, n, ids, begin, tape in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                for start, size, sequence, offset in cut_pieces(begin, n, tape, length):
                    piece = wide[4 * start:4 * (start + size)]
                    for column, value in zip(out, (doc_id, start, size, piece, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
            kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(names))

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of a packing, ids in order: at most `length` tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["offset"])).alias("parts"))
