"""Spread activation: scores walk from seeds over weighted edges, one join a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.sources.store import durable

THRESHOLD = 0.1
DEFAULT_WEIGHT = 0.3


def adjacency(synapses: DataFrame) -> DataFrame:
    """Both directions of each edge as ``(index_id, a, b, weight, pos)``; ``pos`` is creation order.

    A missing weight counts as ``DEFAULT_WEIGHT``.
    """
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")
    pos = F.struct("created_at", "synapse_id").alias("pos")
    there = synapses.select("index_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), weight, pos)
    back = synapses.select("index_id", F.col("to_id").alias("a"), F.col("from_id").alias("b"), weight, pos)
    return there.unionByName(back)


def neighbours(synapses: DataFrame, least: float = 0.0) -> DataFrame:
    return adjacency(synapses).where(F.col("weight") >= least).select("index_id", F.col("a").alias("neuron_id"), F.col("b").alias("neighbour_id"), "weight")


def degrees(synapses: DataFrame) -> DataFrame:
    return adjacency(synapses).groupBy("index_id", F.col("a").alias("neuron_id")).agg(F.count(F.lit(1)).alias("degree"))


def edge_weight(synapses: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(index_id, a, b)`` with the weight of the edge in either direction, 0 where there is none."""
    canonical = synapses.select("index_id", F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi"), "weight").groupBy("index_id", "lo", "hi").agg(F.max("weight").alias("weight"))
    asked = pairs.select("index_id", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return asked.join(canonical, ["index_id", "lo", "hi"], "left").select("index_id", "a", "b", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def spread(seeds: DataFrame, synapses: DataFrame, neurons: DataFrame, depth: int) -> DataFrame:
    """``(index_id, neuron_id, score, hop)``: seeds at hop 0 and what they reach in ``depth`` hops.

    ``seeds(index_id, neuron_id, score)``. A node takes the score of the first parent, in frontier
    order, that lifts it over the threshold, not the largest. Up to two hops are one plan; deeper
    walks keep each frontier as a durable table and stop when one is empty.
    """
    by_score = Window.partitionBy("index_id").orderBy(F.desc("score"), "neuron_id")
    frontier = seeds.select("index_id", "neuron_id", "score", F.row_number().over(by_score).alias("rank"))
    reached = frontier.select("index_id", "neuron_id", "score", F.lit(0).alias("hop"))
    edges = adjacency(synapses)
    alive = neurons.select("index_id", F.col("neuron_id").alias("b"))
    first = Window.partitionBy("index_id", "b").orderBy("rank", "pos")
    order = Window.partitionBy("index_id").orderBy("rank", "pos")
    for hop in range(depth):
        lifted = F.col("score") * F.col("weight") * F.lit(1.0 / (hop + 2))
        tried = frontier.withColumnRenamed("neuron_id", "a").join(edges, ["index_id", "a"]).withColumn("score", lifted).where(F.col("score") > THRESHOLD)
        seen = reached.select("index_id", F.col("neuron_id").alias("b"))
        fresh = tried.join(seen, ["index_id", "b"], "left_anti").join(alive, ["index_id", "b"], "left_semi")
        won = fresh.withColumn("n", F.row_number().over(first)).where("n = 1")
        frontier = won.select("index_id", F.col("b").alias("neuron_id"), "score", F.row_number().over(order).alias("rank"))
        if depth > 2:
            frontier = durable(frontier)
            if frontier.isEmpty():
                break
        reached = reached.unionByName(frontier.select("index_id", "neuron_id", "score", F.lit(hop + 1).alias("hop")))
    return reached
