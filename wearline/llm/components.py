"""Connected components of an edge table, by alternating star contractions.

Each round links the larger neighbours of every node to its smallest neighbour, then the
smaller ones. Rounds are written tables; the number of rounds grows with the logarithm of the
longest chain. Minima are aggregated before they are joined back, so a node with very many
neighbours is a skewed join, which adaptive execution splits, and never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b) with b < a."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        linked = both.filter("b > a").join(lowest, "a")
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(lowest, "a")
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    mark: Column = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark)).first())


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) of every node with an edge to another; the root is the smallest node of
    the component and has no row. `edges` holds (a, b) in any direction."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stage.keep(
        edges.select(high.alias("a"), low.alias("b")).filter("a <> b").distinct(), "edges"
    )
    mark = _mark(edges)
    while mark[0]:
        mid = stage.replace(_star(edges, True), "large", edges)
        edges = stage.replace(_star(mid, False), "small", mid)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
