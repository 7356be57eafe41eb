"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.stages import written


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and all its v. The minima are a written table, so that
    the join has a plain exchange on both sides and a hub's pairs can be split over several tasks."""
    lowest = written(pairs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m")), "minima")
    return pairs.join(lowest, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger end u to the smaller v."""
    reach = _star(edges)
    down = reach.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(reach.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge down, and it leads to a root: the edges are the components."""
    down = edges.select(F.col("v").alias("u")).distinct()
    return edges.join(down, "u", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """`node`, `component` (the smallest node reachable) for every end of an edge.

    Rows with a null end and loops say nothing and are left out (a node that has only a loop gets no
    row); repeated edges count once. An empty table gives an empty result. Nothing is collected: each
    round is two aggregations with map-side minima and two joins, and rounds grow with the logarithm
    of the longest chain.
    """
    a, b = F.col(src), F.col(dst)
    current = written(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _settled(current):
        current = written(_small(written(_large(current), "large")), "small")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
