"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's greater neighbours to its least neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = both.join(least, "a").where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its lesser neighbours to the least of them; edges run downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").where(F.col("b") != F.col("least"))
    return least.select("a", F.col("least").alias("b")).union(tied.select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for all nodes with an edge but the least.

    ``edges`` has columns ``a`` and ``b`` of one comparable type. Large and small stars alternate
    (Kiveris and others, 2014) until the edges no longer change, a number of rounds that grows
    with the logarithm of the longest path. Each round is written to the shared folder, in place of the
    one before, and the result is a table to ``discard``. A node
    with very many neighbours is a skewed join key, not a group: its least neighbour is
    aggregated before the shuffle.
    """
    plain = edges.where(F.col("a") != F.col("b"))
    stars = written(
        plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        state = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
            found.written_path = stars.written_path
            return found
        seen, before = state, stars
        stars = written(_small_star(_large_star(before)), "stars")
        discard(before)
