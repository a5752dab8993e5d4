"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two joins and two aggregations over the links; nothing comes to the driver but a checksum. Lineage is cut
by writing each round to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of a link table (a, b); the component is its smallest node."""
    links = settle(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        after = links.agg(F.count("a").alias("n"), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("decimal(38,0)")).alias("s")).first()
        if mark == after or not after["n"]:
            break
        mark = after
        links = settle(_star(_star(links, True), False), "links")
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionAll(roots)
