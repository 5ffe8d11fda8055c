"""Connected components of links that never leave the executors.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"): each step
groups by node, keeps a partial minimum before the shuffle, and rewires neighbours to it. The number of edges never
grows, a hub costs no task more than its own edges (the join that hands a hub's minimum out is one that AQE splits), and
after O(log^2 n) rounds every node points at the smallest id of its component. Each round is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge to another; edges: (a long, b long), nulls are no nodes."""
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = cut(_small_star(_large_star(now)))
        # a set of edges is told by its size and two sums; it repeats only when every component is a star
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    member = now.groupBy("a").agg(F.min("b").alias("component"))
    centres = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return member.select(F.col("a").alias("id"), "component").unionByName(centres)
