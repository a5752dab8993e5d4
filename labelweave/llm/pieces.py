"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the model's pieces.

The pieces and their log scores come from a model file. The best segmentation maximises the sum of scores; among equal
sums the earliest start (longest last piece) wins; sums are double precision, so scores of -1e9 do not blur others. A character that no piece covers scores the lowest score less 10 and
falls back to its bytes. Decoding joins pieces and bytes, turns whitespace marks into spaces and drops the added prefix.

No piece holds a mark after another character, and none a character from `breaks` beside others; `Pieces` finds this
from the model. The best path therefore always has a boundary there, and texts are cut into such chunks without
changing the result; new chunks are segmented together, one array operation per (position, depth) of the trie, and
remembered in a bounded cache.

Defined results: a null or empty text has no pieces and decodes to ''; ids that are null decode to null; repeated rows
repeat; a text that holds the mark character itself decodes to a space there (`round_trip` is then false); models with
a character map are refused; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import slices

MARK = "▁"
CACHED_CHUNKS = 200_000
LONG_CHUNK = 96

# Piece kinds and field numbers of the model file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


class DoubleArray:
    """Static trie over bytes in two arrays: the child of s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        tree: dict = {}
        for key, value in keys:
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        window, size = 4096, 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free_from, todo, top = 1, [(0, tree)], 1
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while check[free_from] != -1:
                free_from += 1
            at = free_from
            while True:
                if at + 2 * window + 300 >= size:
                    base, check, value = (np.concatenate([a, np.full(size, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                    size *= 2
                open_slots = at + np.flatnonzero(check[at:at + window] == -1)
                open_slots = open_slots[open_slots > codes[0]]
                for c in codes[1:]:
                    open_slots = open_slots[check[open_slots - codes[0] + c] == -1]
                if len(open_slots):
                    break
                at += window
            start = int(open_slots[0]) - codes[0] - 1
            base[state] = start
            for c in codes:
                check[start + c + 1] = state
                todo.append((start + c + 1, node[c]))
                top = max(top, start + c + 2)
        pad = top + 258
        self.base, self.check, self.value = base[:pad].copy(), check[:pad].copy(), value[:pad].copy()
        self.depth = max((len(k) for k, _ in keys), default=0)


class Pieces:
    """A model file's pieces, their trie, and segmentation of chunks."""

    def __init__(self, path: str) -> None:
        self.texts, self.scores, self.kinds = [], [], []
        self.prefix, self.charsmap = True, b""
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                self.texts.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, self.charsmap, self.squeeze = bool(f.get(3, 1)), f.get(2, b""), bool(f.get(4, 1))
        if self.charsmap or self.squeeze:
            raise ValueError("models that rewrite characters or white space are not supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        plain = [self.scores[i] for i in usable if self.kinds[i] == NORMAL]
        low, high = min(plain), max(plain)
        self.unknown = low - UNKNOWN_PENALTY
        self.score = np.array([len(t.encode()) * high - 0.1 if k == USER else s for t, s, k in zip(self.texts, self.scores, self.kinds)])
        self.trie = DoubleArray([(self.texts[i].encode(), i) for i in usable])
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.unknown_id = self.kinds.index(UNKNOWN)
        if any(MARK in self.texts[i].lstrip(MARK) for i in usable):
            self.chunk = regex.compile(r"(?s).+")
        else:
            joined = {c for i in usable if len(self.texts[i]) > 1 for c in self.texts[i]}
            breaks = "".join(c for c in "\n\t\r" if c not in joined)
            self.chunk = regex.compile(f"[{breaks}]|{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" if breaks else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN
                      else t.encode() for t, k in zip(self.texts, self.kinds)]
        # two generations: what is met again in the older one moves to the newer one
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _path(self, data: bytes, back: list[int], ids: list[int]) -> bytes:
        out, at = [], len(data)
        while at:
            if ids[at] >= 0:
                out.append(ids[at])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(data[back[at]:at]))
            else:
                out.append(self.unknown_id)
            at = back[at]
        return np.array(out[::-1], "<u4").tobytes()

    def segment_one(self, data: bytes) -> bytes:
        """Plain Viterbi for a single long chunk."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        n = len(data)
        best, back, ids = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            width = 1 if data[start] < 0x80 else 2 if data[start] < 0xE0 else 3 if data[start] < 0xF0 else 4
            state, here, single = 0, best[start], False
            for at in range(start, n):
                child = int(base[state]) + data[at] + 1
                if check[child] != state:
                    break
                state = child
                if value[state] >= 0:
                    found = here + score[value[state]]
                    single |= at + 1 - start == width
                    if found > best[at + 1]:
                        best[at + 1], back[at + 1], ids[at + 1] = found, start, int(value[state])
            if not single and here + self.unknown > best[start + width]:
                best[start + width], back[start + width], ids[start + width] = here + self.unknown, start, -1
            start += width
        return self._path(data, back, ids)

    def segment_many(self, chunks: list[bytes]) -> list[bytes]:
        """Viterbi over many short chunks at once: rows are chunks, columns are byte positions."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        length = np.array([len(c) for c in chunks])
        rows, wide = len(chunks), int(length.max())
        text = np.zeros((rows, wide), np.int32)
        for i, c in enumerate(chunks):
            text[i, :len(c)] = np.frombuffer(c, np.uint8)
        best, back, ids = np.full((rows, wide + 1), -np.inf), np.zeros((rows, wide + 1), np.int32), np.full((rows, wide + 1), -1, np.int32)
        best[:, 0] = 0.0
        for start in range(wide):
            live = np.flatnonzero((start < length) & ((text[:, start] & 0xC0) != 0x80))
            if not len(live):
                continue
            first = text[live, start]
            width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single = np.zeros(rows, bool)
            reach = np.zeros(rows, np.int32)
            reach[live] = width
            here, state, on = best[:, start], np.zeros(len(live), np.int32), live
            for depth in range(min(self.trie.depth, wide - start)):
                inside = start + depth < length[on]
                on, state = on[inside], state[inside]
                child = base[state] + text[on, start + depth] + 1
                ok = check[child] == state
                on, state = on[ok], child[ok]
                if not len(on):
                    break
                piece = value[state]
                hit = piece >= 0
                if hit.any():
                    r, p = on[hit], piece[hit]
                    found = here[r] + score[p]
                    single[r[reach[r] == depth + 1]] = True
                    better = found > best[r, start + depth + 1]
                    r, p, found = r[better], p[better], found[better]
                    best[r, start + depth + 1], back[r, start + depth + 1], ids[r, start + depth + 1] = found, start, p
            lone = live[~single[live]]
            if len(lone):
                to, found = start + reach[lone], best[lone, start] + self.unknown
                better = found > best[lone, to]
                lone, to = lone[better], to[better]
                best[lone, to], back[lone, to], ids[lone, to] = found[better], start, -1
        back_list, id_list = back.tolist(), ids.tolist()
        return [self._path(c, b, i) for c, b, i in zip(chunks, back_list, id_list)]

    def _learn(self, chunks: set[str]) -> None:
        coded = sorted(((c, c.encode("utf-8", "replace")) for c in chunks), key=lambda x: len(x[1]))
        short = [x for x in coded if len(x[1]) <= LONG_CHUNK]
        for start in range(0, len(short), 4096):
            part = short[start:start + 4096]
            self.cache.update(zip((c for c, _ in part), self.segment_many([b for _, b in part])))
        self.cache.update((c, self.segment_one(b)) for c, b in coded[len(short):])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian 32-bit numbers."""
        split = [self.chunk.findall((MARK if self.prefix and t else "") + t.replace(" ", MARK)) for t in texts]
        if len(self.cache) > CACHED_CHUNKS:
            self.cache, self.old = {}, self.cache
        new = {c for chunks in split for c in chunks if c not in self.cache}
        known = {c for c in new if c in self.old}
        self.cache.update((c, self.old[c]) for c in known)
        self._learn(new - known)
        return [b"".join(map(self.cache.__getitem__, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_held: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model of a path, built once per process."""
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): ids as packed little-endian 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.encode_all(batch.column(1).to_pylist()), pa.binary())], names=[key, "ids"])

    return (docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .mapInArrow(run, f"{key} long, ids binary"))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches):
            texts = [None if i is None else pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, "ids", "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: number and checksum of its ids, and whether they decode to the text again. One pass, no shuffle."""
    names = [key, "n_pieces", "n_byte_pieces", "ids_crc32", "n_chars", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        as_bytes = np.array([k == BYTE for k in pieces.kinds])
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = pieces.encode_all(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([int(as_bytes[np.frombuffer(i, "<u4")].sum()) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([pieces.decode(i) == t for i, t in zip(ids, texts)], pa.bool_())], names=names)

    return (docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .mapInArrow(run, f"{key} long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_chars long, round_trip boolean"))
