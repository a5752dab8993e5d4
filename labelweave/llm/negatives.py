r"""Hard-negative mining: an anchor's best negatives below each of its positives, by segment summaries and then exact scores.

A vector is cut into segments, 2, 4, 8 and so on, and every segment is stored as its mean and its deviation. Of two
segments of length s with means m, n and deviations d, e the inner product lies within s * (m * n - d * e) and
s * (m * n + d * e), since their covariance is at most d * e. Summed over the segments this bounds the score. Pairs whose
bounds rule them out go at the coarsest cut, which is one matrix product for a block of pairs; those that are left are
bounded again by the finer cuts, and only what passes all of them is scored.

1. The vectors that take part are written with their summaries.
2. Anchors, the stated query set, come in rounds of at most ANCHOR_BYTES with their summaries, and each round is sent to
   all tasks. Rows are never shuffled: a task streams its rows and holds the best few per anchor.
3. First round: the best `positives` rows of the anchor's label. A pair is scored if its upper bound reaches the worst of
   the best that the task holds.
4. Second round: for each (anchor, positive) the best `negatives` rows of other labels with a score between the two shares
   of the positive's score. A pair is scored if its bounds meet one of the anchor's windows above the worst that the task
   holds there.
5. The best of all tasks meet by (anchor, positive): a task sends at most `positives * negatives` rows per anchor.

Scores are sums of products of doubles, exact for whole numbers up to 2^53; bounds have slack for rounding. Ties go to the
smaller id.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths are no partners of each other, and empty ones score 0; a row is no partner of an anchor with its id, and
rows that repeat an id are else separate rows, as partners and as anchors; a pair without negatives gives no row, nor does
an anchor without positives; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import settle, slices

CUTS = (2, 4, 8, 16)  # segments at each level
ROWS = 1024  # rows bounded against the anchors at once
PAIRS = 1 << 18  # pairs refined or scored at once
ANCHOR_BYTES = 32 << 20  # vectors and summaries of the anchors of a round

_PACKED = "row long, id long, label string, anchor boolean, dims int, vec binary, means binary, deviations binary"


def segments(dims: int, cut: int) -> np.ndarray:
    """Where the segments of a cut begin, and the end; fewer than `cut` where the vector is short."""
    return np.unique(np.linspace(0, dims, min(cut, max(dims, 1)) + 1).astype(np.int64))


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all cuts, side by side, each times the root of the segment's length."""
    means, deviations = [], []
    for cut in CUTS:
        at = segments(x.shape[1], cut)
        for a, b in zip(at[:-1], at[1:]):
            part, root = x[:, a:b], np.sqrt(b - a)
            mean = part.mean(axis=1)
            means.append(mean * root)
            deviations.append(np.sqrt(np.square(part - mean[:, None]).mean(axis=1)) * root)
    shape = (len(x), 0)
    return (np.stack(means, 1), np.stack(deviations, 1)) if means else (np.zeros(shape), np.zeros(shape))


def pack_vectors(vectors: DataFrame, is_anchor: Column, key: str, label: str, column: str) -> DataFrame:
    """The vectors that take part, as doubles, with their summaries."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ready = vectors.where(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(column).cast("array<double>").alias("v"))
    names = [f.split()[0] for f in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            lists = batch.column(4)
            dims, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                x = flat[start[pick][:, None] + np.arange(d)].reshape(len(pick), d)
                own = batch.take(pa.array(pick))
                packed = [pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary()) for a in (x, *summaries(x))]
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(np.full(len(pick), d), pa.int32()), *packed], names=names)

    return ready.mapInArrow(run, _PACKED)


@dataclass
class Block:
    """Vectors of one length with their summaries."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, pick: np.ndarray) -> Block:
        own = batch.take(pa.array(pick))
        column = lambda c: own.column(own.schema.names.index(c))
        matrix = lambda c: np.frombuffer(b"".join(column(c).to_pylist()), np.float64).reshape(len(pick), -1)
        return cls(column("row").to_numpy(), column("id").to_numpy(), np.array(column("label").to_pylist(), object), matrix("vec"), matrix("means"), matrix("deviations"))

    def levels(self) -> list[slice]:
        """The columns of each cut in the summaries."""
        out, at = [], 0
        for cut in CUTS:
            n = len(segments(self.vec.shape[1], cut)) - 1
            out.append(slice(at, at + n))
            at += n
        return out


def survivors(anchors: Block, rows: Block, same: bool, passes: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of the pairs, of equal or of different labels, whose bounds pass at every cut.

    `passes(i, low, high)` tells for pairs of the anchors `i` whether a score between the bounds is of use.
    """
    pairable = (anchors.label[:, None] == rows.label[None, :]) == same
    pairable &= anchors.id[:, None] != rows.id[None, :]
    size = np.linalg.norm(anchors.vec, axis=1)[:, None] * np.linalg.norm(rows.vec, axis=1)[None, :]
    first, *finer = anchors.levels()
    middle = anchors.means[:, first] @ rows.means[:, first].T
    spread = anchors.deviations[:, first] @ rows.deviations[:, first].T + 1e-9 * size
    i, j = np.nonzero(pairable)
    alive = passes(i, (middle - spread)[i, j], (middle + spread)[i, j])
    i, j = i[alive], j[alive]
    for at in range(0, len(i), PAIRS):
        a, r = i[at:at + PAIRS], j[at:at + PAIRS]
        for level in finer:
            middle = np.einsum("ij,ij->i", anchors.means[a, level], rows.means[r, level])
            spread = np.einsum("ij,ij->i", anchors.deviations[a, level], rows.deviations[r, level]) + 1e-9 * size[a, r]
            alive = passes(a, middle - spread, middle + spread)
            a, r = a[alive], r[alive]
        yield a, r, np.einsum("ij,ij->i", anchors.vec[a], rows.vec[r])


class Best:
    """The best `k` (score, id, row) of each slot: highest score first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.worst = k, np.full(slots, -np.inf)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        near = score >= self.worst[slot]
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot[near]), (self.score, score[near]), (self.id, ids[near])))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(head, np.diff(np.append(head, len(slot))))
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[order][keep], ids[order][keep]
        full = place == self.k - 1
        self.worst[slot[full]] = score[order][full]


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    dims = batch.column(batch.schema.names.index("dims")).to_numpy()
    for d in np.unique(dims):
        yield Block.of(batch, np.flatnonzero(dims == d))


def _rounds(anchors: DataFrame, weight: int) -> Iterator[pa.Table]:
    """The anchors in rounds of at most about ANCHOR_BYTES, cut by ranges of their row number, and with them a bounded collect."""
    per_round = max(1, ANCHOR_BYTES // max(weight, 1))
    n = anchors.count()
    if not n:
        return
    rounds = -(-n // per_round)
    cuts = anchors.approxQuantile("row", [i / rounds for i in range(1, rounds)], 0.1 / rounds) if rounds > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for low, high in zip(edges[:-1], edges[1:]):
        part = anchors
        if low is not None:
            part = part.where(F.col("row") > low)
        if high is not None:
            part = part.where(F.col("row") <= high)
        yield part.toArrow()


def _scan(packed: DataFrame, table: pa.Table, same: bool, k: int, windows: dict[int, list] | None = None) -> DataFrame:
    """(anchor, anchor_id, place, score, id) of the best k rows of each task, for each window of each anchor.

    `windows` gives the (low, high) of an anchor row's windows; without it an anchor has one, and any score counts.
    """
    held = packed.sparkSession.sparkContext.broadcast((table, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, windows), groups = held.value, []
        for batch in table.combine_chunks().to_batches():
            for block in _blocks(batch):
                limits = [[(-np.inf, np.inf)]] * len(block.row) if windows is None else [windows.get(r, []) for r in block.row.tolist()]
                width = max((len(x) for x in limits), default=0)
                low, high = np.full((len(limits), width), np.inf), np.full((len(limits), width), -np.inf)
                for i, x in enumerate(limits):
                    if x:
                        low[i, :len(x)], high[i, :len(x)] = zip(*x)
                groups.append((block, low, high, Best(low.size, k)))
        for batch in slices(batches, ROWS):
            for rows in _blocks(batch):
                for anchors, low, high, best in groups:
                    if anchors.vec.shape[1] != rows.vec.shape[1] or not low.size:
                        continue

                    def passes(i, least, most, low=low, high=high, best=best):
                        floor = np.maximum(low, best.worst.reshape(low.shape))
                        out = np.zeros(len(i), bool)
                        for w in range(low.shape[1]):
                            out |= (most >= floor[i, w]) & (least <= high[i, w])
                        return out

                    for i, j, score in survivors(anchors, rows, same, passes):
                        for w in range(low.shape[1]):
                            inside = (score >= low[i, w]) & (score <= high[i, w])
                            best.add(i[inside] * low.shape[1] + w, score[inside], rows.id[j[inside]])
        for anchors, low, _, best in groups:
            if len(best.slot):
                at, w = np.divmod(best.slot, max(low.shape[1], 1))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.row[at]), pa.array(anchors.id[at]), pa.array(w), pa.array(best.score), pa.array(best.id)],
                                                 names=["anchor", "anchor_id", "place", "score", "id"])

    return packed.mapInArrow(run, "anchor long, anchor_id long, place long, score double, id long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", column: str = "embedding", positives: int = 5,
                   negatives: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each (anchor, positive).

    `is_anchor` is a condition on the columns of `vectors`. A negative's score lies between the two percentages of the positive's score.
    """
    packed = settle(pack_vectors(vectors, is_anchor, key, label, column), "vectors-summed")
    anchors = packed.where("anchor")
    weight = anchors.agg(F.max(F.octet_length("vec") + 2 * F.octet_length("means") + 128).alias("w")).first()["w"] or 0
    out = None
    for table in _rounds(anchors, weight):
        own = settle(_first(_scan(packed, table, True, positives), ["anchor"], positives), "positives")
        limits: dict[int, list] = {}  # of the anchors of this round only: at most `positives` each
        for r in own.select("anchor", "rank", "score").orderBy("anchor", "rank").collect():
            limits.setdefault(r["anchor"], []).append(window(r["score"], low_percent, high_percent))
        found = _first(_scan(packed, table, False, negatives, limits), ["anchor", "place"], negatives)
        pairs = own.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = found.join(pairs, ["anchor", "place"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        part = settle(part, "negatives")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return packed.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    return out


def window(score: float, low_percent: int, high_percent: int) -> tuple[float, float]:
    """The scores s with low * score <= 100 * s <= high * score; for whole scores the bounds are whole too, so the comparison is exact."""
    if score == int(score) and abs(score) < 1 << 53:
        whole = int(score)
        return float(-(-low_percent * whole // 100)), float(high_percent * whole // 100)
    return low_percent * score / 100, high_percent * score / 100
