"""Connected components by alternating large and small stars.

Each half round sends every node to the smallest neighbour it knows; an aggregate with map-side combining
finds that neighbour and a join hands it on, so a node with very many neighbours is never gathered in one task
(both sides of the join are read from tables, so adaptive execution can split its hot partitions). The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)`` that isn't the smallest of its component.

    ``component`` is the smallest node that can be reached. Self-loops, repeated edges and nulls count for nothing;
    an empty table gives an empty table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u > v").distinct()
    edges, before = written(edges), None
    now = _tally(edges)
    while now[0] and now != before:
        before = now
        edges = written(_small(written(_large(edges))).distinct())
        now = _tally(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
