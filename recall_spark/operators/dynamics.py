"""Memory dynamics: firing, decay, pruning, consolidation and self-tuning as table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.operators import filters
from recall_spark.operators.spread import adjacency

FIRE_ENERGY = 0.3


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def fire(energy: Column, times: Column | int = 1) -> Column:
    return F.least(F.lit(1.0), energy + FIRE_ENERGY * times)


def apply_fires(neurons: DataFrame, events: DataFrame) -> DataFrame:
    """``neurons`` after fire events ``(index_id, neuron_id, ts)``: n fires add up in closed form.

    Events are counted before they meet the nodes, so a node that fires often is one row.
    """
    counted = events.groupBy("index_id", "neuron_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_at"))
    met = neurons.join(counted, ["index_id", "neuron_id"], "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return met.withColumns({"energy": F.when(n > 0, fire(F.col("energy"), n)).otherwise(F.col("energy")), "access_count": F.col("access_count") + n, "last_fired_at": F.coalesce("_at", "last_fired_at")}).drop("_n", "_at")


def reactivate(energy: Column, boost: float) -> Column:
    return F.least(F.lit(1.0), energy + boost)


def strengthen(weight: Column, delta: float) -> Column:
    return F.least(F.lit(1.0), weight + delta)


def weaken(weight: Column, delta: float) -> Column:
    return F.greatest(F.lit(0.0), weight - delta)


def decay_nodes(neurons: DataFrame, as_of: Column, rate: float = 0.1) -> DataFrame:
    """Energy lost since the last decay, down to the base energy. Callers pass awake indexes only."""
    lost = rate * seconds_between(as_of, F.col("last_decay_at")) / 3600.0
    return neurons.withColumns({"energy": F.greatest(F.col("base_energy"), F.col("energy") - lost), "last_decay_at": as_of})


def decay_edges(synapses: DataFrame, as_of: Column, rate: float = 0.01) -> DataFrame:
    """One tick: weight lost for all the time since the last co-fire, however many ticks went before."""
    return synapses.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - rate * seconds_between(as_of, F.col("last_co_fire")) / 3600.0))


def decayed_weight(weight: Column, ticks: Column | int, tick_seconds: float, rate: float = 0.01) -> Column:
    """Weight after that many ticks since the last co-fire, in closed form."""
    n = ticks if isinstance(ticks, Column) else F.lit(ticks)
    return F.greatest(F.lit(0.0), weight - rate * tick_seconds * n * (n + 1) / 7200.0)


def prune_edges(synapses: DataFrame) -> DataFrame:
    return synapses.where(filters.edge_alive())


def prune(neurons: DataFrame, synapses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dead nodes go with their edges, then weak edges go."""
    live = neurons.where(filters.alive())
    return live, prune_edges(without_dangling(synapses, live))


def without_dangling(synapses: DataFrame, neurons: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = neurons.select("index_id", "neuron_id").distinct()
    for end in ("from_id", "to_id"):
        synapses = synapses.join(ids.withColumnRenamed("neuron_id", end), ["index_id", end], "left_semi")
    return synapses


def delete_nodes(neurons: DataFrame, synapses: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes ``gone(index_id, neuron_id)`` and every edge at them."""
    for end in ("from_id", "to_id"):
        synapses = synapses.join(gone.select("index_id", F.col("neuron_id").alias(end)).distinct(), ["index_id", end], "left_anti")
    return neurons.join(gone.select("index_id", "neuron_id").distinct(), ["index_id", "neuron_id"], "left_anti"), synapses


def consolidate(neurons: DataFrame, as_of: Column) -> DataFrame:
    """Depth one deeper for nodes that are often used, old and low in energy."""
    return neurons.withColumn("depth", F.col("depth") + F.coalesce(filters.consolidates(as_of), F.lit(False)).cast("int"))


def self_tune(neurons: DataFrame, synapses: DataFrame, rate: float = 0.1, least: float = 0.3) -> DataFrame:
    """``(index_id, avg_degree, learning_rate, min_weight)`` after one tuning step for each index."""
    n = neurons.groupBy("index_id").agg(F.count(F.lit(1)).alias("n"))
    e = synapses.groupBy("index_id").agg(F.count(F.lit(1)).alias("e"))
    degree = 2.0 * F.coalesce("e", F.lit(0)) / F.col("n")
    lr, wm = F.lit(rate), F.lit(least)
    return n.join(e, "index_id", "left").select(
        "index_id",
        degree.alias("avg_degree"),
        F.when(degree < 3, F.least(F.lit(0.3), lr * 1.1)).when(degree > 20, F.greatest(F.lit(0.05), lr * 0.9)).otherwise(lr).alias("learning_rate"),
        F.when(degree < 3, F.greatest(F.lit(0.1), wm * 0.9)).when(degree > 20, F.least(F.lit(0.5), wm * 1.1)).otherwise(wm).alias("min_weight"),
    )


def average_degree(synapses: DataFrame) -> DataFrame:
    return adjacency(synapses).groupBy("index_id").agg((F.count(F.lit(1)) / F.countDistinct("a")).alias("avg_degree"))


def update_content(neurons: DataFrame, where: Column, content: Column, as_of: Column) -> DataFrame:
    """New content and hash, and one fire; vectors and labels stay as they were."""
    from recall_spark.functions.text import content_hash

    new = {"content": content, "energy": fire(F.col("energy")), "access_count": F.col("access_count") + 1, "last_fired_at": as_of}
    if "content_hash" in neurons.columns:
        new["content_hash"] = content_hash(content)
    return neurons.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in new.items()})


def update(neurons: DataFrame, where: Column, spec: dict) -> DataFrame:
    """The update language: ``$set`` of content, tags and metadata, ``$inc`` of energy, ``$push`` of a tag."""
    new: dict[str, Column] = {}
    for field, value in spec.get("$set", {}).items():
        if field == "content":
            new["content"] = F.lit(value)
        elif field == "tags":
            new["tags"] = F.array(*[F.lit(x) for x in value])
        elif field == "metadata":
            keys = list(value)
            rest = F.map_filter("metadata", lambda k, _: ~k.isin(keys))
            new["metadata"] = F.map_concat(rest, F.create_map(*[F.lit(str(x)) for kv in value.items() for x in kv]))
    if "energy" in spec.get("$inc", {}):
        new["energy"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("energy") + float(spec["$inc"]["energy"])))
    if "tags" in spec.get("$push", {}):
        new["tags"] = F.array_append(new.get("tags", F.coalesce("tags", F.array().cast("array<string>"))), F.lit(spec["$push"]["tags"]))
    return neurons.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in new.items()})
