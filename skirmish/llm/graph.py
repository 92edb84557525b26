"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{label}-large")
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), f"{label}-small")
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root: each node of ``edges`` (a, b) with the smallest node it can reach.

    Every step is written to the shared folder, so no lineage grows and a lost executor costs one step.  The
    minimum of a node's neighbours is aggregated before it is shuffled and joined back, so a node with very many
    edges is split like any skewed join key.  Ends when a round leaves the edges as they were; self-loops and
    repeated edges are ignored, no edges give no rows.
    """
    state = None
    edges = materialise(_clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), label)
    while True:
        large = materialise(_clean(_large_star(edges, label)), label)
        edges = materialise(_clean(_small_star(large, label)), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
