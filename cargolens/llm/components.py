"""Connected components by alternating stars (Kiveris et al., SoCC 2014), as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cargolens.llm.storage import BROADCAST_ROWS, discard, observed, small, written


# Many edges: the minima are a written table, so both sides of the join are plain exchanges, which
# AQE can split where one node has many edges. Few edges have few minima, which are broadcast.


def _large_star(edges: DataFrame, few: bool) -> tuple[DataFrame, dict]:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    minima = F.broadcast(minima) if few else small(kept := written(minima, "minima"))
    found = both.filter("v > u").join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _next_edges(found, edges, *(() if few else (kept,)))


def _small_star(edges: DataFrame, few: bool) -> tuple[DataFrame, dict]:
    minima = edges.groupBy("u").agg(F.min("v").alias("m"))
    if not few:
        minima = kept = written(minima, "minima")
    found = edges.join(F.broadcast(minima) if few else small(minima), "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    found = found.union(minima.select("u", F.col("m").alias("v")))
    return _next_edges(found, edges, *(() if few else (kept,)))


def _next_edges(found: DataFrame, *used: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a written table, and their number and a hash of them, seen while written."""
    edges, seen = observed(
        found.filter("u <> v").distinct(), "edges", n=F.count(F.lit(1)),
        h=F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
    )
    discard(*used)
    return edges, seen


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected to, for all nodes of edges.

    Nodes may be of any ordered type. Loops, repeated edges and edges with a null end are
    ignored; nodes that only have such edges are not returned. Every round is a few joins over
    edges; the number of rounds grows with the logarithm of the number of nodes.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now, found = _next_edges(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = None
    while found != before and found["n"]:
        before, few = found, found["n"] <= BROADCAST_ROWS // 2  # an edge has two ends
        for star in (_large_star, _small_star):
            now, found = star(now, few)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("node"), F.col("v")).distinct())
