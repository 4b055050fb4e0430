"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("hi <> lo").groupBy("hi", "lo").agg(F.lit(1).alias("_n")).select("hi", "lo")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour (or to itself, if smaller)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return _distinct(moved.union(least.select("hi", F.col("m").alias("lo"))))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (hi, lo) except the roots themselves.

    Alternating large and small stars: a number of rounds that grows with the logarithm of the nodes, each one
    joins and aggregates over the edges, written to the shared folder.  The driver sees one checksum a round.
    Hubs are met by partial aggregates and by splitting skewed joins.
    """
    edges, before = written(_distinct(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")))), None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark.n:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before, edges = mark, written(_small_star(_large_star(edges)))
