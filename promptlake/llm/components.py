"""Connected components of an edge table by alternating stars (joins and grouped minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlake.llm.base import apart, discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node in its reach of one; edges may repeat."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(apart(least), "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    moved = down.join(apart(least), "n")
    return (
        moved.select(F.col("m").alias("a"), F.col("s").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        .where("a < b")
        .distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node is only a centre, or below one centre only."""
    side = edges.select(F.col("a").alias("n"), F.lit(0).alias("below")).distinct().unionByName(edges.select(F.col("b").alias("n"), F.lit(1).alias("below")))
    mixed = side.groupBy("n").agg(F.count("*").alias("times")).where("times > 1")
    return mixed.isEmpty()


def connected(edges: DataFrame, name: str = "graph") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node.

    Each round's edges are written to the shared folder; the number of rounds
    grows with the logarithm of the longest path, and the last is the one after which
    no node is both above and below another. An empty table gives an empty one.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    while not _stars(edges):
        older, edges = edges, stored(_small(_large(edges)), name)
        discard(older)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
