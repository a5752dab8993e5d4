r"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least `least_chars` code points
that two or more documents hold lose all their lines, except in the document with the smallest id.

1. Texts are packed once into batches of a few megabytes. Each batch sends the 128-bit hashes of its distinct keys to
   shards, with the smallest and largest id that holds each and the number of its documents: copies of a line cost one
   entry per batch, however many documents of the batch hold it.
2. A shard builds its index over the distinct hashes: a minimal perfect hash (levels of bit arrays; a key stands at the
   first level where no other key falls on its place, and its number is the rank of that bit) and, at that number,
   a 32-bit fingerprint, the count of documents and the owner (the smallest id).
3. Documents probe: the hashes of a batch meet the arrays of their shard, and one bit per key comes back with the
   owners of repeated keys. No line is joined, and what moves is some 20 bytes per distinct line and batch.
4. Batches drop the lines whose key repeats and has another owner.

The number of shards grows with the bytes of the texts, so a shard's arrays stay bounded. All lines of a document set are
in the index, so a probe of it is exact up to equal 128-bit hashes; the fingerprint rejects lines from elsewhere.

Defined results: null and empty texts are one empty line; a null id counts as smaller than all others and stays null;
rows with one id are one document, so they do not drop lines from each other; a repeated line within one document stays;
lines without a key of `least_chars` stay; texts of any length are read whole; empty tables give no rows; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import settle, shuffle_width, sized_slices, slices

LEAST_CHARS = 10
BATCH_BYTES = 4 << 20
SHARD_BYTES = 64 << 20  # of text, for each shard
GAMMA = 2  # places per key that is still to be placed
NULL_ID = -(1 << 63)

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class PerfectHash:
    """Numbers 0 .. n-1 for n distinct 128-bit keys, in about 5 bits a key."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits  # bits of all levels, each level from a word of its own
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(first + _mix(second + _U(level))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(first):
            size = -(-max(64, GAMMA * len(first)) // 64) * 64
            at = cls.places(first, second, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            first, second = first[left], second[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for what no level holds. A foreign key may get any number."""
        out, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.places(first[left], second[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = (self.bits[word] >> bit & _U(1)).astype(bool)
            below = self.bits[word[held]] & ((_U(1) << bit[held]) - _U(1))
            out[left[held]] = self.ranks[word[held]] + np.bitwise_count(below)
            left, base = left[~held], base + size
        return out


class LineIndex:
    """The arrays of a shard: fingerprint, number of documents and owner of every distinct key."""

    FIELDS = "shard int, sizes array<bigint>, bits binary, prints binary, counts binary, owners binary"

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> None:
        self.hashed, self.prints, self.counts, self.owners = hashed, prints, counts, owners

    @staticmethod
    def print_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (_mix(first ^ _U(0x9E3779B97F4A7C15)) + second >> _U(32)).astype(np.uint32)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, least: np.ndarray, most: np.ndarray, count: np.ndarray) -> LineIndex:
        """From entries (key, smallest id, largest id, documents) of batches. A document may lie in several batches only
        where its id repeats, so counts add up but for those; whether there are two documents is told by the ids."""
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        if not len(head):
            return cls(PerfectHash.build(a, b), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        low, high = np.minimum.reduceat(least[order], head), np.maximum.reduceat(most[order], head)
        counts = np.minimum(np.add.reduceat(count[order], head), (1 << 32) - 1)
        a, b = a[head], b[head]
        hashed = PerfectHash.build(a, b)
        to = np.argsort(hashed.numbers(a, b))
        counts = np.where(low == high, 1, np.maximum(counts, 2)).astype(np.uint32)
        return cls(hashed, cls.print_of(a, b)[to], counts[to], low[to])

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, owner) of keys; 0 documents for a key that is not in the index."""
        if not len(self.prints):
            return np.zeros(len(first), np.int64), np.full(len(first), NULL_ID)
        number = self.hashed.numbers(first, second)
        known = (number >= 0) & (self.prints[number] == self.print_of(first, second))
        return np.where(known, self.counts[number], 0).astype(np.int64), self.owners[number]

    def row(self, shard: int) -> dict:
        return {"shard": [shard], "sizes": [self.hashed.sizes], "bits": [self.hashed.bits.tobytes()], "prints": [self.prints.tobytes()],
                "counts": [self.counts.tobytes()], "owners": [self.owners.tobytes()]}

    @classmethod
    def of_row(cls, row: dict) -> LineIndex:
        hashed = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64))
        return cls(hashed, np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["owners"], np.int64))


# ---- batches


def pack_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(batch, ids, sizes, data): documents in batches of about BATCH_BYTES, texts compressed together."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    names = ["batch", "ids", "sizes", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, press = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(1)
        ids, texts, held = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts))], pa.binary())], names=names)

        for batch in sized_slices(batches, 1):
            for doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(doc_id)
                texts.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    return ready.mapInArrow(run, "batch long, ids array<bigint>, sizes array<bigint>, data binary")


class Batch:
    """The lines of a batch and its distinct keys, in order of (shard, hash)."""

    def __init__(self, row: dict, shards: int, least_chars: int) -> None:
        whole, at = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(sum(row["sizes"]), 1)) if sum(row["sizes"]) else b"", 0
        self.ids = row["ids"]
        self.lines, numbers, owners, known = [], [], [], {}
        for doc, size in enumerate(row["sizes"]):
            lines = whole[at:at + size].split(b"\n")
            at += size
            self.lines.append(lines)
            for line in lines:
                key = line.strip().lower()  # of bytes: the ASCII white space and letters only
                long = len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)
                numbers.append(known.setdefault(key, len(known)) if long else -1)
                owners.append(doc)
        hashes = np.frombuffer(b"".join(blake2b(k, digest_size=16).digest() for k in known), np.uint64).reshape(-1, 2)
        shard = ((hashes[:, 0] >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], shard))
        self.shard, self.first, self.second = shard[order], hashes[order, 0], hashes[order, 1]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers, owners = np.array(numbers, np.int64), np.array(owners, np.int64)
        self.rids = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        self.key = np.where(numbers >= 0, place[numbers] if len(place) else -1, -1)  # of every line
        self.rid = self.rids[owners]
        # smallest and largest id, and number of ids, of every key
        held = np.flatnonzero(self.key >= 0)
        by = np.lexsort((self.rid[held], self.key[held]))
        k, r = self.key[held][by], self.rid[held][by]
        new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])) if len(k) else np.zeros(0, bool)
        k, r = k[new], r[new]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        self.least, self.count = r[head], np.diff(np.append(head, len(k)))
        self.most = r[head + self.count - 1] if len(k) else r


def _send(packed: DataFrame, shards: int, least_chars: int) -> DataFrame:
    """(shard, batch, n, keys, ids): the distinct keys of each batch."""
    names = ["shard", "batch", "n", "keys", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for rows in slices(batches, 1):
            row = rows.to_pylist()[0]
            b = Batch(row, shards, least_chars)
            cuts = np.searchsorted(b.shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            keys = [b.first[x:y].tobytes() + b.second[x:y].tobytes() for x, y in zip(cuts[full], cuts[full + 1])]
            ids = [press.compress(b"".join(v[x:y].astype("<i8").tobytes() for v in (b.least, b.most, b.count))) for x, y in zip(cuts[full], cuts[full + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), row["batch"]), pa.int64()),
                                              pa.array(np.diff(cuts)[full], pa.int64()), pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], names=names)

    return packed.mapInArrow(run, "shard int, batch long, n long, keys binary, ids binary")


def _halves(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(keys, np.uint64)
    return both[:len(both) // 2], both[len(both) // 2:]


def build_index(sent: DataFrame) -> DataFrame:
    """One row of arrays for each shard."""
    def run(table: pa.Table) -> pa.Table:
        unpress, parts = zstandard.ZstdDecompressor(), []
        for n, keys, ids in zip(*(table.column(c).to_pylist() for c in ("n", "keys", "ids"))):
            parts.append((*_halves(keys), *np.frombuffer(unpress.decompress(ids, max_output_size=24 * n), np.int64).reshape(3, n)))
        index = LineIndex.build(*(np.concatenate(x) for x in zip(*parts)))
        return pa.table(index.row(table.column("shard")[0].as_py()), schema=pa.schema([
            ("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("bits", "prints", "counts", "owners"))]))

    return sent.groupBy("shard").applyInArrow(run, LineIndex.FIELDS)


def _probe(sent: DataFrame, index: DataFrame) -> DataFrame:
    """(batch, shard, repeated, owners): of a batch's keys in a shard, which repeat, and the owners of those."""
    def run(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        press, index = zstandard.ZstdCompressor(1), LineIndex.of_row(arrays.to_pylist()[0])
        repeated, owners = [], []
        for keys in asked.column("keys"):
            documents, owner = index.probe(*_halves(keys.as_py()))
            repeated.append(np.packbits(documents > 1).tobytes())
            owners.append(press.compress(owner[documents > 1].tobytes()))
        return pa.table({"batch": asked.column("batch"), "shard": asked.column("shard"), "repeated": pa.array(repeated, pa.binary()),
                         "owners": pa.array(owners, pa.binary())})

    return (sent.select("shard", "batch", "keys").groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInArrow(run, "batch long, shard int, repeated binary, owners binary"))


def _apply(joined: DataFrame, shards: int, least_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in slices(batches, 1):
            row = rows.to_pylist()[0]
            b = Batch(row, shards, least_chars)
            cuts, owner = np.searchsorted(b.shard, np.arange(shards + 1)), np.zeros(len(b.shard), np.int64)
            gone = np.zeros(len(b.shard), bool)  # keys that repeat
            for answer in row["answers"] or []:
                x, y = cuts[answer["shard"]], cuts[answer["shard"] + 1]
                gone[x:y] = np.unpackbits(np.frombuffer(answer["repeated"], np.uint8), count=y - x).astype(bool)
                owner[x:y][gone[x:y]] = np.frombuffer(unpress.decompress(answer["owners"], max_output_size=8 * (y - x)), np.int64)
            dropped = (b.key >= 0) & gone[b.key] & (owner[b.key] != b.rid) if len(gone) else np.zeros(len(b.key), bool)
            out, at = [], 0
            for doc_id, lines in zip(b.ids, b.lines):
                drop = dropped[at:at + len(lines)]
                at += len(lines)
                kept = b"\n".join(line for line, d in zip(lines, drop.tolist()) if not d) if drop.any() else b"\n".join(lines)
                out.append((doc_id, len(lines), int(np.count_nonzero(drop)), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")


def drop_repeated_lines(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text (`kept`) of every row of `docs`."""
    packed = settle(pack_documents(docs, text), "lines-packed")
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("n")).first()["n"] or 0
    shards = max(shuffle_width(docs.sparkSession), total // SHARD_BYTES)
    sent = settle(_send(packed, shards, least_chars), "line-keys")
    index = settle(build_index(sent), "line-index")
    answers = _probe(sent, index).groupBy("batch").agg(F.collect_list(F.struct("shard", "repeated", "owners")).alias("answers"))
    out = _apply(packed.join(answers, "batch", "left").select("batch", "ids", "sizes", "data", "answers"), shards, least_chars)
    return out.withColumn("kept", F.col("kept").cast("string"))
