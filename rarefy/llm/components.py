"""Connected components by alternating large-star and small-star rounds.

Edges and labels stay in distributed tables.  Every round is written to the
shared checkpoint folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least node it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them.

    Edges come with ``a > b``.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (tied.unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); the root is the least node.

    Self links, repeated and reversed edges are allowed; nodes without an edge
    do not appear.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                           F.least("a", "b").alias("b"))
    now = materialise(ordered.distinct())
    seen = _summary(now)
    while seen[0]:
        nxt = materialise(_small_star(_large_star(now)))
        found = _summary(nxt)
        now, done = nxt, found == seen
        seen = found
        if done:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
