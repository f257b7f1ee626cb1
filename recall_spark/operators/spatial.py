"""Positions in [-1, 1]^d: seeding, growth with the number of nodes, and one reorganising step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.vector import clamped, lerp
from recall_spark.operators.spread import adjacency


def uniform(key: Column, dim: Column, seed: int = 0) -> Column:
    """A number in [-1, 1) from a hash of its arguments, the same on every run."""
    return F.pmod(F.xxhash64(key, dim, F.lit(seed)), F.lit(1 << 32)) / float(1 << 31) - 1.0


def random_position(key: Column, dims: Column | int, seed: int = 0, scale: float = 1.0) -> Column:
    d = dims if isinstance(dims, Column) else F.lit(dims)
    return F.transform(F.sequence(F.lit(1), d), lambda i: uniform(key, i, seed) * scale)


def near(position: Column, key: Column, reach: float, seed: int = 0) -> Column:
    """A position within ``reach`` of another in each coordinate."""
    return clamped(F.transform(position, lambda x, i: x + uniform(key, i + 1, seed) * reach))


def dimension(n: Column, least: int = 3, most: int = 1000) -> Column:
    """Dimensions after n inserts: one more for each hundred nodes."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n / 100.0).cast("int")))


def shrunk(dims: Column, n: Column, least: int = 3) -> Column:
    """One dimension less, after a delete, where there are fewer than ten nodes for each."""
    return F.when((n / dims < 10) & (dims > least), dims - 1).otherwise(dims)


def resized(position: Column, dims: Column, key: Column, seed: int = 0) -> Column:
    """Truncated, or filled up with small coordinates."""
    more = F.transform(F.sequence(F.lit(1), dims), lambda i: uniform(key, i, seed) * 0.1)
    return F.when(F.size(position) >= dims, F.slice(position, 1, dims)).otherwise(F.concat(position, F.slice(more, F.size(position) + 1, dims)))


def attract(a: Column, b: Column, strength: float | Column) -> Column:
    """``a`` moved towards the midpoint of both."""
    middle = F.zip_with(a, b, lambda x, y: (x + y) / 2.0)
    return clamped(lerp(a, middle, strength))


def neighbour_centroids(neurons: DataFrame, synapses: DataFrame, least: float = 0.3) -> DataFrame:
    """Mean position of each node's neighbours over edges stronger than ``least``."""
    places = neurons.select("index_id", F.col("neuron_id").alias("b"), "position")
    met = adjacency(synapses).where(F.col("weight") > least).join(places, ["index_id", "b"])
    flat = met.select("index_id", "a", F.posexplode("position").alias("i", "x"))
    mean = flat.groupBy("index_id", "a", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("index_id", F.col("a").alias("neuron_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def repelled(neurons: DataFrame, synapses: DataFrame, strength: float, others: int = 5, seed: int = 0) -> DataFrame:
    """Nodes pushed from up to ``others`` unconnected nodes of their index.

    Candidates are ring neighbours in a seeded hash order, so no index is crossed with itself.
    """
    order = Window.partitionBy("index_id").orderBy(F.xxhash64("neuron_id", F.lit(seed)), "neuron_id")
    ahead = F.collect_list(F.struct(F.col("neuron_id").alias("b"), "position")).over(order.rowsBetween(1, 2 * others))
    near_by = neurons.withColumn("ahead", ahead).select("index_id", F.col("neuron_id").alias("a"), F.col("position").alias("own"), F.explode("ahead").alias("o"))
    linked = adjacency(synapses).select("index_id", "a", F.col("b").alias("b")).distinct()
    free = near_by.select("index_id", "a", "own", F.col("o.b").alias("b"), F.col("o.position").alias("other")).join(linked, ["index_id", "a", "b"], "left_anti")
    ranked = free.withColumn("n", F.row_number().over(Window.partitionBy("index_id", "a").orderBy("b"))).where(F.col("n") <= others)
    pushes = ranked.select("index_id", F.col("a").alias("neuron_id"), F.posexplode(F.zip_with("own", "other", lambda x, y: x - y)).alias("i", "x"))
    total = pushes.groupBy("index_id", "neuron_id", "i").agg(F.avg("x").alias("x"))
    push = total.groupBy("index_id", "neuron_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("_push"))
    moved = neurons.join(push, ["index_id", "neuron_id"], "left")
    return moved.withColumn("position", F.when(F.col("_push").isNull(), F.col("position")).otherwise(clamped(F.zip_with("position", "_push", lambda x, p: x + p * strength)))).drop("_push")


def reorganise(neurons: DataFrame, synapses: DataFrame, least: float = 0.3, rate: float = 0.05) -> DataFrame:
    """One synchronous step: every node moves towards its neighbours' centroid, by mean strength.

    All nodes move at once from the same snapshot, where a sequential pass would use places that have
    already moved.
    """
    centroids = neighbour_centroids(neurons, synapses, least)
    strength = adjacency(synapses).where(F.col("weight") > least).groupBy("index_id", F.col("a").alias("neuron_id")).agg((F.avg("weight") * rate).alias("_s"))
    met = neurons.join(centroids, ["index_id", "neuron_id"], "left").join(strength, ["index_id", "neuron_id"], "left")
    moved = clamped(F.zip_with("position", "centroid", lambda x, y: x + (y - x) * F.col("_s") * 0.5))
    return met.withColumn("position", F.when(F.col("centroid").isNull(), F.col("position")).otherwise(moved)).drop("centroid", "_s")
