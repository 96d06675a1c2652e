"""Connected components of a graph held as edges, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that isn't its own root, its lineage cut; root: the component's smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours;
    the number of rounds grows with the logarithm of the longest path. It ends when each node has one
    link, to a node without any. Edges may repeat or be loops.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        least = _ends(now).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = cut(now.join(least, "b").select("a", F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ends(edges: DataFrame) -> DataFrame:
    """edges (a, b) in both directions."""
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _stars(edges: DataFrame) -> bool:
    """Whether no node of edges (a, b), a > b, has two smaller neighbours or a smaller and a larger one."""
    ends = _ends(edges).groupBy("a").agg(F.count_if(F.col("b") < F.col("a")).alias("down"), F.count("*").alias("n"))
    return ends.filter("down > 0 and n > 1").isEmpty()
