r"""N-gram Jaccard join: all links between shingle sets with similarity of at least 0.8, exactly, as components.

The Jaccard distance is a metric, and so is the size of the symmetric difference. Pivots are single shingles: a set is at
distance 1 - 1/n from each of its own and 1 from all others, and the rank of their hashes breaks the tie. A set's home
region is that of its pivot of lowest rank; triangle-inequality windows replicate it to more. For linked sets x and y
the difference x \ y has at most a fifth of x, so the shingle of lowest rank that they share stands in the first fifth of
both rankings, the window, and they meet in its region. They also meet in more: of the at least 4/9 (|x| + |y|) shingles
that they share, at most max(|x| - w(x), |y| - w(y)) lie beyond one of the windows, so they share at least the rest of
them as regions.

Each region is then joined recursively by documents as pivots. The pivot is compared with all members; members within the
threshold join its component, and what is left (members of other components, pairs not yet compared) goes to the next
round with the next pivot. Pairs that sizes, the number of shared regions, or the parity sketch rule out are not compared:
the sketch holds the parities of hash buckets, which differ in at most |x| + |y| - 2 |x & y| places, so it only rejects
pairs that cannot link. A large set has a sketch that grows with it, which comes along where a region is crowded, so that
long documents that share a passage and nothing else are told apart. The last round compares all pairs that are left, so no link between different components is lost.

Equal sets are folded to one before regions are joined, and copies within a batch before they travel. Comparisons bring
compressed texts together, in groups of bounded size, and count shared shingles on the whole sets.

Defined results: null texts and texts without words have an empty set, link with nothing and are components of their
own; with one to four words the whole sequence is the one shingle; null ids count as the smallest id inside a
component and come back null; rows with one id are separate documents that share the id; empty tables give no rows;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import settle, shuffle_width, slices
from labelweave.llm.components import components

WORDS, PERCENT = 5, 80
SKETCH_BITS = 512
BUCKETS = 4  # buckets of regions per shuffle partition; one is held by a task at a time
GROUP = 256  # texts compared with one pivot in one task
PIVOT_ROUNDS = 2
WIDE_FROM = 300  # shingles from which the plain sketch tells little
CROWD = 4  # members of a region from which wide sketches come along
EARLY = 8  # first crowded regions that a member knows, so that a pair is made in one of them only
SMALL = 512  # members of a region among which partners are looked for before any text is read
NULL_ID = -(1 << 63)

_U = np.uint64
_CODES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(55).integers(0, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
_tables: dict = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text, in order, in blocks that end at white space."""
    if "up" not in _tables:
        _tables["up"], _tables["down"] = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
    out, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + BLOCK)
        if end < len(data):
            cut = max(data.rfind(s, begin, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= begin else end
            if cut < begin:  # a word longer than a block: hash it alone
                stop = begin
                while stop < len(data) and data[stop] > 32 or stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
                    stop += 1
                out.append(_hash_words(np.frombuffer(data[begin:stop], np.uint8)))
                begin = stop
                continue
        out.append(_hash_words(np.frombuffer(data[begin:end], np.uint8)))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    up, down = _tables["up"], _tables["down"]
    if len(raw) > BLOCK:
        up, down = _powers(_BASE, len(raw) + 1), _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * down[:len(raw)], out=sums[1:])
    return _mix((sums[stop] - sums[first]) * up[first] + (stop - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text: its pivots in rank order."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < WORDS:
        return _mix(np.array([np.sum(words * _STEPS[:len(words)], dtype=np.uint64) + _U(len(words))], np.uint64))
    total = words[:len(words) - WORDS + 1] * _STEPS[0]
    for i in range(1, WORDS):
        total = total + words[i:len(words) - WORDS + 1 + i] * _STEPS[i]
    return np.unique(_mix(total))


def sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the number of shingles in each bucket; differs between two sets in at most |x ^ y| places."""
    return np.packbits(np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def wide_sketch(shingles: np.ndarray) -> bytes | None:
    """For a set that fills the plain sketch, one of two places or more per shingle; a power of two, so that it folds to half."""
    return sketch(shingles, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) > WIDE_FROM else None


class WideSketches:
    """Sketches of different widths, compared at the width of the smaller one: halves are folded by exclusive or."""

    def __init__(self, packed: list[bytes | None]) -> None:
        self.bits = np.array([0 if p is None else 8 * len(p) for p in packed], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held, members = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for level in sorted(set(self.bits.tolist()) - {0}, reverse=True):
            while held.shape[1] > level // 64:
                half = held.shape[1] // 2
                held = held[:, :half] ^ held[:, half:]
            own = np.flatnonzero(self.bits == level)
            rows = np.frombuffer(b"".join(packed[i] for i in own), np.uint64).reshape(len(own), -1)
            held = np.concatenate([held, rows]) if len(held) else rows
            members = np.concatenate([members, own])
            place = np.full(len(packed), -1)
            place[members] = np.arange(len(members))
            self.levels[level] = held, place

    def close(self, i: int, js: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which of `js` may link with `i`; `total` is the sum of both sizes."""
        keep = np.ones(len(js), bool)
        width = np.minimum(self.bits[js], self.bits[i])
        for level in np.unique(width[width > 0]).tolist():
            at = np.flatnonzero(width == level)
            held, place = self.levels[level]
            for start in range(0, len(at), 4096):
                part = at[start:start + 4096]
                apart = np.bitwise_count(held[place[js[part]]] ^ held[place[i]]).sum(axis=1, dtype=np.int64)
                keep[part] = 9 * apart <= total[part]
        return keep


_STEP = "kind string, row long, doc_id long, n long, digest binary, sketch binary, wide binary, bucket int, keys binary, content binary"


def _replicate(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """A `docs` row per document, and `regions` rows: the regions of its window, packed by bucket."""
    ready = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    names = [f.split()[0] for f in _STEP.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        press = zstandard.ZstdCompressor(1)
        for batch in slices(batches):
            out, seen, parts = [], set(), []
            for row, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(data)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                out.append(("docs", row, doc_id, len(s), digest, sketch(s), wide_sketch(s), None, None, hashlib.sha256(data).digest()))
                if len(s) and digest not in seen:
                    seen.add(digest)
                    kept = s[:_window(len(s))]
                    parts.append((kept, np.full(len(kept), row), np.full(len(kept), len(s))))
            if parts:
                hashes, rows, sizes = (np.concatenate(x) for x in zip(*parts))
                bucket = ((hashes & _U(0xFFFFFFFF)) * _U(buckets) >> _U(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    take = order[cuts[i]:cuts[i + 1]]
                    packed = hashes[take].tobytes() + b"".join(a[take].astype("<i8").tobytes() for a in (rows, sizes))
                    out.append(("regions", None, None, len(take), None, None, None, int(i), press.compress(packed), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return ready.mapInArrow(run, _STEP)


def _shared_regions(table: pa.Table) -> pa.Table:
    """Members of the regions of a bucket in which different rows meet."""
    unpress, parts = zstandard.ZstdDecompressor(), []
    for n, keys in zip(table.column("n").to_pylist(), table.column("keys").to_pylist()):
        raw = unpress.decompress(keys, max_output_size=24 * n)
        parts.append([np.frombuffer(raw[8 * n * i:8 * n * (i + 1)], "<u8" if i == 0 else "<i8") for i in range(3)])
    region, row, size = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(region, kind="stable")
    region, row, size = region[order], row[order], size[order]
    first = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(region) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(region)))
    keep = np.repeat(count > 1, count)
    return pa.table({"region": pa.array(region[keep].view(np.int64)), "row": row[keep], "n": size[keep]})


def _window(n):
    """Shingles of a set of n whose regions it joins."""
    return n * (100 - PERCENT) // 100 + 1


def enough_regions(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of sizes n and m that share so many regions can link."""
    beyond = F.greatest(n - F.floor(n * (100 - PERCENT) / 100) - 1, m - F.floor(m * (100 - PERCENT) / 100) - 1)
    return (100 + PERCENT) * (shared + beyond) >= PERCENT * (n + m)


def _possible(members: DataFrame, buckets: int) -> DataFrame:
    """Members without those that no other member of their region can link with, by size and sketch.

    Regions of more than SMALL members keep all; the pivots and the last round test their pairs.
    """
    def partners(m, n, bits):
        apart = np.zeros((len(m), len(m)), np.int64)
        for word in range(bits.shape[1]):
            apart += np.bitwise_count(bits[m, word][:, None] ^ bits[m, word][None, :])
        size = n[m]
        total = size[:, None] + size[None, :]
        ok = (9 * apart <= total) & (
            100 * np.minimum(size[:, None], size[None, :]) >= PERCENT * np.maximum(size[:, None], size[None, :]))
        np.fill_diagonal(ok, False)
        return ok.any(axis=1)

    def run(table: pa.Table) -> pa.Table:
        region, row, n = (table.column(c).to_numpy() for c in ("region", "row", "n"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        order = np.argsort(region, kind="stable")
        first = np.flatnonzero(np.append(True, region[order][1:] != region[order][:-1]))
        count = np.diff(np.append(first, len(order)))
        keep = np.zeros(len(order), bool)
        a, b = order[first[count == 2]], order[first[count == 2] + 1]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        both = (9 * apart <= n[a] + n[b]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
        keep[a[both]] = keep[b[both]] = True
        for x, size in zip(first[count > 2], count[count > 2]):
            m = order[x:x + size]
            keep[m] = True if size > SMALL else partners(m, n, bits)
        return pa.table({"region": region[keep], "row": row[keep], "n": n[keep]})

    return (members.withColumn("_bucket", F.pmod(F.xxhash64("region"), F.lit(8 * buckets))).groupBy("_bucket")
            .applyInArrow(run, "region long, row long, n long"))


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """(rid, data): ids and compressed texts, which travel at a third of their size."""
    ready = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["rid", "data"])

    return ready.mapInArrow(run, "rid long, data binary")


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. Texts meet their pivot `a` in groups of at most about GROUP members."""
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("b") / GROUP).alias("_parts")), "a")
    sized = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"))
    members = sized.join(texts, sized["b"] == texts["row"]).select("a", "part", "row", "data")
    pivots = sized.select("a", "part").distinct().join(texts, F.col("a") == texts["row"]).select("a", "part", "row", "data")

    def run(table: pa.Table) -> pa.Table:
        unpress, linked = zstandard.ZstdDecompressor(), set()
        read = lambda z: shingle_set(unpress.decompress(z, max_output_size=1 << 31))
        rows, pivot = table.column("row").to_pylist(), table.column("a")[0].as_py()
        datas = table.column("data")
        centre = read(datas[rows.index(pivot)].as_py())
        for row, data in zip(rows, datas):
            if row != pivot and row not in linked:
                s = read(data.as_py())
                shared = len(np.intersect1d(centre, s, assume_unique=True))
                if 100 * shared >= PERCENT * (len(centre) + len(s) - shared):
                    linked.add(row)
        return pa.table({"a": pa.array([pivot] * len(linked), pa.int64()), "b": pa.array(sorted(linked), pa.int64())})

    return members.unionAll(pivots).groupBy("a", "part").applyInArrow(run, "a long, b long")


def _with_early(members: DataFrame) -> DataFrame:
    """Members of crowded regions with `early`, the first EARLY of their row's crowded regions; null for the others.

    Two rows that share a region in both lists are seen together there, with the same bounds, so later regions need not make the pair.
    """
    crowded = F.col("_held") > CROWD
    early = members.where(crowded).groupBy("row").agg(F.slice(F.array_sort(F.collect_set("region")), 1, EARLY).alias("early"))
    return members.join(early, "row", "left").withColumn("early", F.when(crowded, F.col("early")))


def _left_pairs(members: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) from different components that no bound rules out.

    A pair that passes the wide sketches of a crowded region is compared, one that does not cannot link. So such a pair needs no
    count of its regions, and the first of them that both rows know makes it. Pairs of other regions are counted.
    """
    def run(table: pa.Table) -> pa.Table:
        region, row, n, comp = (table.column(c).to_numpy() for c in ("region", "row", "n", "component"))
        early = table.column("early").to_pylist()
        known = np.array([[] if e is None else e + e[-1:] * (EARLY - len(e)) for e in early if e is not None], np.int64).reshape(-1, EARLY)
        place = np.cumsum([e is not None for e in early]) - 1
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        wide = WideSketches(table.column("wide").to_pylist())
        order = np.lexsort((n, region))
        cuts = np.flatnonzero(np.append(True, region[order][1:] != region[order][:-1]))
        left, right, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for x, y in zip(cuts, np.append(cuts[1:], len(order))):
            m = order[x:y]
            size = n[m]
            crowded = early[m[0]] is not None
            for i in range(len(m) - 1):
                stop = np.searchsorted(size, size[i] * 100 // PERCENT, side="right")  # members are in order of size
                js = m[i + 1:stop]
                js = js[comp[js] != comp[m[i]]]
                if crowded and len(js):
                    own = known[place[m[i]]]
                    for before in own[own < region[m[i]]]:
                        js = js[(known[place[js]] != before).all(axis=1)]
                if len(js):
                    apart = np.bitwise_count(bits[js] ^ bits[m[i]]).sum(axis=1, dtype=np.int64)
                    js = js[9 * apart <= n[js] + size[i]]
                    if wide.bits[m[i]] and len(js):
                        js = js[wide.close(m[i], js, n[js] + size[i])]
                    left.append(np.full(len(js), m[i]))
                    right.append(js)
                    near.append(np.full(len(js), crowded))
        i, j, near = np.concatenate(left), np.concatenate(right), np.concatenate(near)
        swap = row[i] > row[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pair = np.lexsort((row[j], row[i]))
        i, j, near = i[pair], j[pair], near[pair]
        new = np.flatnonzero(np.append(True, (row[i][1:] != row[i][:-1]) | (row[j][1:] != row[j][:-1]))) if len(i) else np.zeros(0, np.int64)
        return pa.table({"a": row[i[new]], "b": row[j[new]], "na": n[i[new]], "nb": n[j[new]], "c": np.diff(np.append(new, len(i))),
                         "near": np.logical_or.reduceat(near, new) if len(new) else near})

    found = (_with_early(members).drop("_held").withColumn("_bucket", F.pmod(F.xxhash64("region"), F.lit(8 * buckets))).groupBy("_bucket")
             .applyInArrow(run, "a long, b long, na long, nb long, c long, near boolean"))
    counted = found.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("near").alias("near"))
    return counted.where(F.col("near") | enough_regions(F.col("c"), F.col("na"), F.col("nb"))).select("a", "b")


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`."""
    return joined_rows(docs, text).select("doc_id", "n_shingles", "component_id")


def joined_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, content, component of every row of `docs`.

    `content` is the SHA-256 of the text. Ids may be null or repeat, so components share a component_id at times; `component`
    tells them apart, and is null for rows without shingles, which are components of their own.
    """
    spark = docs.sparkSession
    buckets = shuffle_width(spark)
    step = settle(_replicate(docs, text, BUCKETS * buckets), "shingles", "kind")
    rows = step.where("kind = 'docs'").select("row", "doc_id", "n", "digest", "sketch", "wide", "content")
    # equal sets are one from here on; an empty set links with nothing
    classes = rows.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep"), F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least"))
    classes = settle(classes, "classes")
    heads = rows.join(classes.select(F.col("rep").alias("row")), "row")
    shared = (step.where("kind = 'regions'").select("bucket", "n", "keys").groupBy("bucket")
              .applyInArrow(_shared_regions, "region long, row long, n long"))
    members = shared.join(heads.select("row", "sketch"), "row")
    members = settle(_possible(members, buckets), "regions", release=True)
    # the texts of all members, found by id and told apart by their set's size and digest
    wanted = members.select("row").distinct().join(heads, "row").select("row", F.coalesce("doc_id", F.lit(NULL_ID)).alias("rid"), "digest")
    texts = settle(_matching(_packed(docs, text).join(wanted, "rid").select("row", "digest", "data")), "texts", release=True)

    # a new round takes each region's pivot from outside its main component; pairs that share too few of the pivot's
    # regions wait for the last round, which counts all regions of a pair
    links = checked = spark.createDataFrame([], "a long, b long")
    open_members = members.withColumn("component", F.col("row")).withColumn("_order", F.col("row"))
    for last in (False,) * PIVOT_ROUNDS + (True,):
        several = open_members.groupBy("region").agg(
            F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("row").alias("_held"),
            F.min(F.struct("_order", F.col("row").alias("pivot"), F.col("n").alias("pn"), F.col("component").alias("pc"))).alias("_first"))
        several = several.where("_low < _high")
        if last:
            left = (open_members.join(several.select("region", "_held"), "region").join(heads.select("row", "sketch", "wide"), "row")
                    .withColumn("wide", F.when(F.col("_held") > CROWD, F.col("wide"))))
            pairs = _left_pairs(left, buckets)
        else:
            near = open_members.join(several.select("region", "_first.*").drop("_order", "_held"), "region").where(
                (F.col("component") != F.col("pc")) & (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")))
            counted = near.groupBy(F.col("pivot").alias("a"), F.col("row").alias("b"), "n", "pn").agg(F.count("region").alias("c"))
            pairs = counted.where(enough_regions(F.col("c"), F.col("n"), F.col("pn"))).select("a", "b")
        seen = checked.unionAll(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = settle(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        if not pairs.take(1):
            continue
        links = links.unionAll(settle(_compare(pairs, texts), "found", release=True))
        checked = checked.unionAll(pairs)
        if not last:
            parts = settle(components(links), "components")
            joined = members.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
            size = parts.groupBy("component").agg(F.count("node").alias("_size"))
            joined = joined.join(size, "component", "left")
            open_members = settle(joined.withColumn("_order", F.struct(F.coalesce("_size", F.lit(1)), F.xxhash64("row"))).drop("_size"), "members")
    parts = settle(components(links), "components")
    # the smallest id of a component, over all copies of its sets
    whole = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.select("digest", "n", "component").join(least, "component").select("digest", F.col("n").alias("_n"), "component_id", "component")
    own = F.coalesce("component_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    return (rows.join(named, (rows["digest"] == named["digest"]) & (rows["n"] == named["_n"]), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(own != NULL_ID, own).alias("component_id"), "content", "component"))


def _matching(rows: DataFrame) -> DataFrame:
    """(row, data): compressed texts whose set has the wanted digest. A repeated document may come twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        unpress = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            kept = [(row, data) for row, digest, data in zip(*(c.to_pylist() for c in batch.columns)) if hashlib.blake2b(
                shingle_set(unpress.decompress(data, max_output_size=1 << 31)).tobytes(), digest_size=16).digest() == digest]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.int64()), pa.array([d for _, d in kept], pa.binary())], names=["row", "data"])

    return rows.mapInArrow(run, "row long, data binary")
