"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import cut, sum_hash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that isn't its component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): a number of rounds that grows
    with the logarithm of the longest path. No neighbourhood is ever collected; a hub is only a hot
    join key, which adaptive execution splits. An empty edge list gives an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    mark = sum_hash(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        before, mark = mark, sum_hash(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
