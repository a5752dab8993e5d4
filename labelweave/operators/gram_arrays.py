"""N-grams of a slice of texts by numpy, for tasks that read Arrow batches.

A gram is a whole number made of the places of its characters in the slice's alphabet, so counting is sorting numbers. Where
these no longer fit 63 bits they are numbered anew; no n-gram is ever hashed or left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from labelweave.functions.normalize import WHITESPACE

# Characters that are counted together; a longer text is a slice of its own.
SLICE_CHARS = 1 << 21

# The same where n-grams are only looked up: what is sorted then fits a cache.
LOOKUP_CHARS = 1 << 18

BITS = 63

# White space, by code point; what lies beyond is none.
_WHITE = np.zeros(ord(max(WHITESPACE)) + 2, bool)
_WHITE[[ord(c) for c in WHITESPACE]] = True


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty, bytes that are no UTF-8 are replaced."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(kind).to_pylist()]


def slices(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` characters, or one row."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def single_texts(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str], None]]:
    """Slices of a column of texts: first row, end, and the texts. No rows are one empty slice."""
    texts = strings(column)
    for a, b in list(slices([len(t) for t in texts], limit)) or [(0, 0)]:
        yield a, b, texts[a:b], None


def owned_texts(column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Slices of a column of lists of texts: first row, end, the texts, and the row of each text, from 0."""
    texts, each = strings(column.flatten()), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(each)])
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for a, b in slices(np.diff(chars[upto]).tolist()):
        yield a, b, texts[upto[a]:upto[b]], np.repeat(np.arange(b - a), each[a:b])


def pieces(columns: dict[str, pa.Array], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The columns as batches of a bounded number of rows."""
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for start in range(0, len(whole), rows):
        yield whole.slice(start, rows)


def as_strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as Arrow strings."""
    data = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    sizes = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


def collapsed(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, and their sizes, with every run of two or more white-space characters of a text as one blank."""
    white = _WHITE[np.minimum(points, len(_WHITE) - 1)]
    pair, ends = white[1:] & white[:-1], np.cumsum(sizes)
    pair[ends[(ends > 0) & (ends < len(points))] - 1] = False  # runs end with their text
    at = np.flatnonzero(pair)
    if not len(at):
        return points, sizes
    points, kept = points.copy(), np.ones(len(points), bool)
    points[at], kept[at + 1] = ord(" "), False
    return points[kept], sizes - np.bincount(np.searchsorted(ends, at + 1, side="right"), minlength=len(sizes))


def _runs(texts: Sequence[str], nmin: int, nmax: int, owner: np.ndarray | None = None, collapse: bool = False):
    """For each length: what spells codes as code points, and (owner, code, count) of each owner's n-grams by owner and code."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    if collapse:
        points, sizes = collapsed(points, sizes)
    if owner is None:
        owner = np.arange(len(texts))
    top = int(points.max(initial=0)) + 1
    seen = np.zeros(top, bool)
    seen[points] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    bits, owner_bits = max(1, int(len(letters) - 1).bit_length()), max(1, int(owner.max(initial=0)).bit_length())
    kind = np.uint32 if bits * nmax + owner_bits <= 32 else np.int64  # numbers half as wide are sorted twice as fast
    place = np.zeros(top, kind)
    place[letters] = np.arange(len(letters))
    char, of, ends = place[points], np.repeat(owner.astype(kind), sizes), np.cumsum(sizes)
    head, digits, width = np.zeros((1, 0), np.uint32), 0, 0  # a code: a row of head, then `digits` characters
    code = np.zeros(len(points), kind)

    def speller(head: np.ndarray, digits: int):
        def spelled(codes: np.ndarray) -> np.ndarray:
            tail = [letters[(codes >> (bits * k)) & ((1 << bits) - 1)] for k in reversed(range(digits))]
            return np.column_stack([head[codes >> (bits * digits)], *tail])

        return spelled

    for n in range(1, nmax + 1):
        if len(points) < n:
            return
        code = code[:len(points) - n + 1]
        if width + bits + owner_bits > BITS:
            known, code = np.unique(code, return_inverse=True)
            head, digits, width, code = speller(head, digits)(known.astype(np.int64)), 0, int(len(known) - 1).bit_length(), code.astype(kind)
        code = code << bits | char[n - 1:]
        digits, width = digits + 1, width + bits
        if n < nmin:
            continue
        key = of[:len(code)] << width | code
        beyond = np.concatenate([np.zeros(0, np.int64), *[ends[sizes >= k] - k for k in range(1, n)]])  # n-grams that reach over the end of their text
        beyond = beyond[beyond < len(code)]
        key[beyond] = np.iinfo(kind).max
        key.sort()
        key = key[:len(key) - len(beyond)]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        once = key[first]
        yield speller(head, digits), (once >> width).astype(np.int64), once & ((1 << width) - 1), np.diff(np.append(first, len(key)))


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.unique(codes)
    return found.astype(np.int64), np.searchsorted(found, codes)


def gram_counts(texts: Sequence[str], nmin: int, nmax: int, owner: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the distinct n-grams, and (owner, n-gram, count) of each owner's n-grams by owner.

    The owner of a text is its own place, unless several texts count as one.
    """
    for spelled, of, codes, tf in _runs(texts, nmin, nmax, owner):
        found, gram = _numbered(codes)
        yield as_strings(spelled(found)), of, gram, tf


def text_counts(texts: Sequence[str], nmin: int, nmax: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each length: the distinct n-grams of texts with runs of white space collapsed, and in how many texts each occurs."""
    for spelled, _, codes, _ in _runs(texts, nmin, nmax, collapse=True):
        found, n = np.unique(codes, return_counts=True)
        yield as_strings(spelled(found.astype(np.int64))), n


def places(grams: pa.Array, held: pa.Array) -> np.ndarray:
    """Place of each n-gram among the held ones, -1 if it is none of them."""
    return pc.fill_null(pc.index_in(grams, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Held:
    """N-grams that are looked up often: for each length their numbers, sorted, with their places. Numbers are made of the places of
    characters in the alphabet of all of them; n-grams too long for that are looked up as strings."""

    def __init__(self, grams: pa.Array):
        texts = strings(grams)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters = np.unique(points)
        self.bits = max(1, len(self.letters).bit_length())
        starts = np.cumsum(sizes) - sizes
        self.numbers, self.words = {}, {}
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            if n * self.bits > BITS:
                self.words[n] = grams.take(pa.array(mine)), mine
                continue
            numbers, _ = self._numbers(points[starts[mine][:, None] + np.arange(n)])
            order = np.argsort(numbers)
            self.numbers[n] = numbers[order], mine[order]

    def _numbers(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, known = np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for column in points.T:
            at = np.searchsorted(self.letters, column)
            known &= self.letters[np.minimum(at, len(self.letters) - 1)] == column
            number = number << self.bits | at
        return number, known

    def places(self, points: np.ndarray) -> np.ndarray:
        """Place of each n-gram, a row of code points, among the held ones, -1 if it is none of them."""
        n = points.shape[1]
        if n in self.words:
            words, mine = self.words[n]
            at = places(as_strings(points), words)
            return np.where(at < 0, -1, mine[at])
        if n not in self.numbers:
            return np.full(len(points), -1)
        numbers, mine = self.numbers[n]
        asked, known = self._numbers(points)
        at = np.minimum(np.searchsorted(numbers, asked), len(numbers) - 1)
        return np.where(known & (numbers[at] == asked), mine[at], -1)


def known_terms(texts: Sequence[str], nmin: int, nmax: int, held: Held, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place among the held n-grams, count * idf) of every held n-gram of every text, runs of white space collapsed."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for spelled, of, codes, tf in _runs(texts, nmin, nmax, collapse=True):
        found, gram = _numbered(codes)
        at = held.places(spelled(found))[gram]
        known = at >= 0
        parts.append((of[known], at[known], tf[known] * idf[at[known]]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def norms(of: np.ndarray, column: np.ndarray, raw: np.ndarray, texts: int) -> np.ndarray:
    """Length of each text's vector; what shares a column is one value of it."""
    cells, cell = np.unique(of << 32 | column, return_inverse=True)
    return np.sqrt(np.bincount(cells >> 32, np.bincount(cell, raw, len(cells)) ** 2, texts))


def lists(of: np.ndarray, texts: int, values: pa.Array, kind: pa.DataType, empty: bool) -> pa.ListArray:
    """The values, which are in the order of their texts, as one list per text; without values an empty one, or null."""
    each = np.bincount(of, minlength=texts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, type=kind, mask=None if empty else pa.array(each == 0))


def strongest(of: np.ndarray, place: np.ndarray, size: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sizes of each text, largest first, the smaller rank on a tie, in the order of texts."""
    order = np.lexsort((rank[place], -size, of))
    mine = of[order]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
    since = np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))
    return order[since < k]
