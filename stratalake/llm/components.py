"""Connected components of a graph of any size, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges: equal when a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round lets every node point its larger neighbours at its smallest one (large star), then its smaller neighbours at their
    smallest (small star); edges never grow in number, and the rounds are logarithmic in the nodes. A node's neighbours are never gathered:
    minima come from partial aggregates and are joined back, where AQE splits hot nodes. Loops and repeated edges are fine, edges with a
    null end are no edges; no edges give no rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    links = checkpointed(edges.where("a <> b").distinct())
    mark = _mark(links)
    for _ in range(rounds):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        links = checkpointed(small)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    parts = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    rest = loops.select("node", F.col("node").alias("component"))
    return parts.unionByName(roots).unionByName(rest).groupBy("node").agg(F.min("component").alias("component"))
