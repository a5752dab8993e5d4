"""Near-duplicate vectors by NN-descent: cosine of at least a threshold, in double precision.

1. Equal vectors fold to one node with a weight.
2. Nodes get first neighbour lists from blocks of vectors with equal hyperplane codes, in several tables.
3. Each round joins neighbours of neighbours (lists and their reverses) and keeps the best; rounds end when few lists change.
4. Links at the threshold give components. A node whose list holds links only is saturated: its list is enlarged to its
   whole component and the best `k` outside it, found by the same descent over the saturated nodes. Links among those
   join components, and the search is repeated, with new tables, until no saturated list gains a link.
5. The links inside each component are counted exactly, in blocks of bounded size.
6. The audit compares a bounded, hash-chosen set of query vectors with all vectors. Below `min_recall` the search goes on with
   more tables, and after the last attempt every vector is compared with every other in blocks; links that the audit
   finds are kept.

Blocks, reverse lists and components are split to a bounded number of vectors per task, by a salt, so a vector that a
third of all rows resemble does not fill one task. No list of nodes, links or components comes to the driver.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing, have
0 links, and are their own components; vectors of different lengths never link; null ids count as the smallest id of a
component and come back null; rows with one id are separate vectors; equal vectors are linked with each other; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import bounded, settle, slices
from labelweave.llm.components import components

BLOCK = 1024  # vectors compared with each other in one task
CODE_ROWS = 512  # vectors per hyperplane code, on average
NULL_ID = -(1 << 63)


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, kind) for v in packed]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, str]:
    """(row, id, vec): vectors packed as numbers of their own type, null where they cannot link."""
    kind = "<f4" if vectors.schema[column].dataType.elementType.simpleString() == "float" else "<f8"
    ready = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(column).alias("v"))

    def pack(v):
        if not v or any(x is None for x in v):
            return None
        x = np.array(v, kind)
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(v) for v in batch.column(2).to_pylist()], pa.binary())],
                                             names=["row", "id", "vec"])

    return ready.mapInArrow(run, "row long, id long, vec binary"), kind


_NEAR = "node long, other long, cosine double"


def _near_table(node, other, cosine) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(other, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _outside(table: pa.Table, kind: str) -> np.ndarray:
    """Cosines of all pairs of a block; -2 within a component, and so for a node with itself."""
    x, component = _unit(table.column("vec").to_pylist(), kind), table.column("component").to_numpy()
    s = x @ x.T
    s[component[:, None] == component[None, :]] = -2
    return s


def _first_lists(nodes: DataFrame, kind: str, count: int, tables: range, k: int) -> DataFrame:
    """Neighbours in other components within blocks of equal codes, the best k of each block."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / CODE_ROWS)))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            packed = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in packed])
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                x = _unit([packed[i] for i in pick], kind)
                for t in tables:
                    planes = np.random.default_rng([t, int(d)]).standard_normal((x.shape[1], max(bits, 1)))
                    code = ((x @ planes > 0) @ (1 << np.arange(max(bits, 1)))) if bits else np.zeros(len(pick), np.int64)
                    part = batch.take(pa.array(pick))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), t), pa.int32()), pa.array(np.full(len(pick), d), pa.int32()),
                                                      pa.array(code.astype(np.int64)), part.column(0), part.column(1), part.column(2)],
                                                     names=["t", "d", "code", "node", "vec", "component"])

    step = "t int, d int, code long, node long, vec binary, component long"
    coded = nodes.select("node", "vec", "component").mapInArrow(codes, step)
    sizes = nodes.select("node", "vec", "component").mapInArrow(codes, step).groupBy("t", "d", "code").agg(
        F.ceil(F.count("node") / BLOCK).alias("parts"))
    blocks = coded.join(sizes, ["t", "d", "code"]).withColumn("part", F.pmod(F.xxhash64("t", "node"), F.col("parts"))).drop("parts")

    def best(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        if len(node) < 2:
            return _near_table([], [], [])
        s = _outside(table, kind)
        top = np.argpartition(-s, min(k, len(node) - 1) - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, top, 1).ravel()
        kept = near > -2
        return _near_table(np.repeat(node, top.shape[1])[kept], node[top.ravel()][kept], near[kept])

    return blocks.groupBy("t", "d", "code", "part").applyInArrow(best, _NEAR)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    ranked = candidates.groupBy("node", "other").agg(F.max("cosine").alias("cosine")).withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("place") <= k).drop("place")


def _descend(lists: DataFrame, inner: DataFrame | None, nodes: DataFrame, kind: str, k: int) -> DataFrame:
    """Better neighbours from joining each node's neighbours, forward and reverse, with those in other components.

    `inner` are lists whose members are joined too, but not made better.
    """
    least = lists.groupBy("node").agg(F.min("cosine").alias("worst"), F.count("other").alias("held"))
    facts = nodes.select("node", "vec", "component").join(least, "node", "left").select(
        F.col("node").alias("member"), "vec", "component", F.when(F.col("held") >= k, F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"))
    near = lists.select("node", "other") if inner is None else lists.select("node", "other").unionAll(inner.select("node", "other"))
    around = near.select(F.col("node").alias("centre"), F.col("other").alias("member")).unionAll(
        near.select(F.col("other").alias("centre"), F.col("node").alias("member"))).distinct()
    parts = around.groupBy("centre").agg(F.ceil(F.count("member") / 128).alias("parts"))
    around = around.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts"))).drop("parts")

    def run(table: pa.Table) -> pa.Table:
        node = table.column("member").to_numpy()
        if len(node) < 2:
            return _near_table([], [], [])
        s = _outside(table, kind)
        i, j = np.nonzero(s > table.column("worst").to_numpy()[:, None])
        return _near_table(node[i], node[j], s[i, j])

    return around.join(facts, "member").groupBy("centre", "part").applyInArrow(run, _NEAR)


def _converge(lists: DataFrame, inner: DataFrame | None, nodes: DataFrame, kind: str, k: int, few: float) -> DataFrame:
    """The lists after as many rounds as it takes until at most `few` entries change. Entries only get better, so rounds end."""
    while True:
        after = settle(_best(lists.unionAll(_descend(lists, inner, nodes, kind, k)), k), "lists")
        changed = after.select("node", "other").exceptAll(lists.select("node", "other")).count()
        lists = after
        if changed <= few:
            return lists


def _enlarge(lists: DataFrame, links: DataFrame, nodes: DataFrame, kind: str, threshold: float, k: int, tables: range, min_change: float
             ) -> tuple[DataFrame, DataFrame]:
    """Links and components after saturated lists are enlarged to their components and the best k outside them.

    A link that is cut by k at one end only stands in the other end's list, so the search is among saturated nodes.
    """
    full = lists.groupBy("node").agg(F.min("cosine").alias("worst"), F.count("other").alias("held")).where(
        (F.col("held") >= k) & (F.col("worst") >= threshold)).select("node")
    saturated = settle(nodes.select("node", "vec").join(full, "node"), "saturated")
    count = saturated.count()
    while True:
        parts = settle(components(links), "components")
        placed = settle(saturated.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        ends = placed.agg(F.min("component").alias("low"), F.max("component").alias("high")).first()
        if ends["low"] == ends["high"]:
            return links, parts
        outer = settle(_best(_first_lists(placed, kind, count, tables, k), k), "lists")
        outer = _converge(outer, lists, placed, kind, k, min_change * k * count)
        gained = settle(outer.where(F.col("cosine") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b")), "gained")
        if not gained.take(1):
            return links, parts
        links, tables = links.unionAll(gained), range(tables.stop, tables.stop + len(tables))


def _block_pairs(members: DataFrame, by: str) -> DataFrame:
    """Members once for each pair (i, j) of blocks of their group `by` that they take part in."""
    sizes = members.groupBy(by).agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *members.columns, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block")


def _every_pair(nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links (a, b) between components from comparing all vectors; of a pair of blocks, one for each pair of components."""
    def run(table: pa.Table) -> pa.Table:
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        i, j = np.nonzero(np.triu(_outside(table, kind) >= threshold))
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        first = np.unique(np.stack([low, high]), axis=1, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
        return pa.table({"a": node[i[first]], "b": node[j[first]]})

    pairs = _block_pairs(nodes.select("node", "vec", "component", F.octet_length("vec").alias("size")), "size")
    return pairs.groupBy("size", "i", "j").applyInArrow(run, "a long, b long")


def _component_counts(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, linked): weight of the other nodes of its component at the threshold, over pairs of blocks."""
    pairs = _block_pairs(members.select("component", "node", "vec", "weight"), "component")

    def run(table: pa.Table) -> pa.Table:
        node, weight, block = (table.column(c).to_numpy() for c in ("node", "weight", "block"))
        x = _unit(table.column("vec").to_pylist(), kind)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            return pa.table({"node": node[a], "linked": (near @ weight[b]).astype(np.int64)})
        return pa.table({"node": np.concatenate([node[a], node[b]]), "linked": np.concatenate([near @ weight[b], near.T @ weight[a]]).astype(np.int64)})

    return pairs.groupBy("component", "i", "j").applyInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _audit(nodes: DataFrame, kind: str, threshold: float, queries: int) -> DataFrame:
    """All links of a bounded set of query nodes, by comparing them with every node: (a, b)."""
    asked = bounded(nodes.select("node", "vec"), F.xxhash64(F.lit("audit"), "node"), queries).collect()
    by_size: dict[int, list] = {}
    for r in asked:
        by_size.setdefault(len(r["vec"]), []).append((r["node"], bytes(r["vec"])))
    held = nodes.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            node, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            dims = np.array([len(v) for v in packed])
            for d, group in held.value.items():
                pick = np.flatnonzero(dims == d)
                if len(pick):
                    q = np.array([g[0] for g in group])
                    i, j = np.nonzero(_unit([g[1] for g in group], kind) @ _unit([packed[p] for p in pick], kind).T >= threshold)
                    a, b = q[i], node[pick[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return nodes.select("node", "vec").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", k: int = 6, tables: int = 8,
                    min_change: float = 0.01, min_recall: float = 0.98, queries: int = 256, attempts: int = 3) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    packed, kind = _rows(vectors, key, column)
    rows = settle(packed, "vectors")
    own = F.coalesce("id", F.lit(NULL_ID))
    nodes = settle(rows.where("vec is not null").groupBy("vec").agg(F.min("row").alias("node"), F.count("row").alias("weight"), F.min(own).alias("least")), "nodes")
    count = nodes.count()
    truth = settle(_audit(nodes, kind, threshold, queries), "audit")
    apart = nodes.select("node", "vec", F.col("node").alias("component"))
    lists, links = None, truth.limit(0)
    for attempt in range(attempts):
        first = _first_lists(apart, kind, count, range(attempt * tables, (attempt + 1) * tables), k)
        lists = settle(_best(first if lists is None else first.unionAll(lists), k), "lists")
        lists = _converge(lists, None, apart, kind, k, min_change * k * count)
        links = links.unionAll(lists.where(F.col("cosine") >= threshold).select(F.col("node").alias("a"), F.col("other").alias("b")))
        start = 1_000_000 * (attempt + 1)
        links, parts = _enlarge(lists, links, nodes, kind, threshold, k, range(start, start + tables), min_change)
        side = lambda n: parts.select(F.col("node").alias(n), F.col("component").alias(f"_{n}"))
        met = truth.join(side("a"), "a", "left").join(side("b"), "b", "left").agg(
            F.count("a").alias("n"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("hit")).first()
        if met["hit"] >= min_recall * met["n"]:
            break
    else:
        placed = apart.drop("component").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        links = links.unionAll(settle(_every_pair(placed, kind, threshold), "links"))
    parts = settle(components(links.unionAll(truth)), "components")
    members = parts.join(nodes.select("node", "vec", "weight"), "node")
    counts = _component_counts(members, kind, threshold)
    named = parts.join(parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id")), "component")
    facts = (nodes.select("node", "vec", "weight", "least").join(counts, "node", "left").join(named.select("node", "component_id"), "node", "left")
             .select("vec", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("_component")))
    out = rows.join(facts, "vec", "left").withColumn("_component", F.coalesce("_component", own))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("_component") != NULL_ID, F.col("_component")).alias("component_id"), (own == F.col("_component")).alias("kept"))
