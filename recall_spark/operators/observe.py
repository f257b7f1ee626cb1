"""Statistics, exports, the activity feed and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.text import truncated
from recall_spark.operators.dynamics import seconds_between, without_dangling


def index_stats(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """Counts and means for each index; an index without edges has mean weight 0."""
    n = neurons.groupBy("index_id").agg(F.count(F.lit(1)).alias("neuron_count"), F.avg("energy").alias("avg_energy"))
    e = synapses.groupBy("index_id").agg(F.count(F.lit(1)).alias("synapse_count"), F.avg("weight").alias("avg_weight"))
    return n.join(e, "index_id", "left").select("index_id", "neuron_count", F.coalesce("avg_energy", F.lit(0.0)).alias("avg_energy"), F.coalesce("synapse_count", F.lit(0).cast("long")).alias("synapse_count"), F.coalesce("avg_weight", F.lit(0.0)).alias("avg_weight"))


def depth_histogram(neurons: DataFrame) -> DataFrame:
    return neurons.groupBy("index_id", "depth").agg(F.count(F.lit(1)).alias("neurons"))


def weights(synapses: DataFrame) -> DataFrame:
    """Edge weights of each index in ascending order, one row for each rank."""
    by = Window.partitionBy("index_id").orderBy("weight", "synapse_id")
    return synapses.select("index_id", F.row_number().over(by).alias("rank"), "weight")


def snapshot(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    n = neurons.groupBy("index_id").agg(F.count(F.lit(1)).alias("neuron_count"), F.sum("energy").alias("total_energy"), F.max(F.size("position")).alias("dim"), F.max("last_fired_at").alias("modified_at"))
    e = synapses.groupBy("index_id").agg(F.count(F.lit(1)).alias("synapse_count"))
    return n.join(e, "index_id", "left").withColumn("synapse_count", F.coalesce("synapse_count", F.lit(0).cast("long")))


def activation_counters(fires: DataFrame) -> DataFrame:
    return fires.groupBy("index_id").agg(F.count(F.lit(1)).alias("total_activations"), F.max("ts").alias("last_activity"))


def graph_nodes(neurons: DataFrame) -> DataFrame:
    return neurons.select("index_id", F.col("neuron_id").alias("id"), "content", "energy", "depth", "position")


def graph_edges(synapses: DataFrame) -> DataFrame:
    return synapses.select("index_id", F.col("from_id").alias("source"), F.col("to_id").alias("target"), "weight")


def activity_feed(neurons: DataFrame, synapses: DataFrame, as_of: Column, seconds: float = 300, limit: int = 100) -> DataFrame:
    """What fired, formed or strengthened in the last five minutes: the newest hundred, oldest first."""
    two = lambda c: F.format_string("%.2f", c)

    def part(df: DataFrame, ts: str, kind: str, action: Column, details: Column, key: str) -> DataFrame:
        fresh = (seconds_between(as_of, F.col(ts)) < seconds) & (seconds_between(as_of, F.col(ts)) >= 0)
        return df.where(fresh).select("index_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(kind).alias("type"), action.alias("action"), details.alias("details"), F.col(key).alias("key"))

    told = truncated(F.col("content"), 50)
    events = (
        part(neurons, "last_fired_at", "neuron", F.lit("FIRED"), told, "neuron_id")
        .unionByName(part(neurons, "created_at", "neuron", F.lit("CREATED"), told, "neuron_id"))
        .unionByName(part(synapses, "last_co_fire", "synapse", F.concat(F.lit("STRENGTHENED ("), two(F.col("weight")), F.lit(")")), F.concat(F.lit("co-fired "), F.col("co_fire_count").cast("string"), F.lit(" times")), "synapse_id"))
        .unionByName(part(synapses, "created_at", "synapse", F.lit("FORMED"), F.concat(F.lit("weight: "), two(F.col("weight"))), "synapse_id"))
    )
    newest = events.orderBy(F.desc("timestamp"), "type", "action", "key").limit(limit)
    return newest.orderBy("timestamp", "type", "action", "key")


def integrity(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """One row of counts: rows checked, dangling edges, repeated contents and values out of range."""
    n = neurons.agg(F.count(F.lit(1)).alias("neurons_checked"), F.count_if(~F.col("energy").between(0, 1) | F.col("energy").isNull()).alias("bad_energy"))
    e = synapses.agg(F.count(F.lit(1)).alias("synapses_checked"), F.count_if(~F.col("weight").between(0, 1) | F.col("weight").isNull()).alias("bad_weight"))
    whole = without_dangling(synapses, neurons).agg(F.count(F.lit(1)).alias("_whole"))
    repeats = neurons.groupBy("index_id", "content").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("repeated_contents"))
    # Four tables of one row each.
    one = n.join(e, F.lit(True)).join(whole, F.lit(True)).join(repeats, F.lit(True))
    return one.select("neurons_checked", "synapses_checked", (F.col("synapses_checked") - F.col("_whole")).alias("dangling_synapses"), "repeated_contents", "bad_energy", "bad_weight")


def repaired(neurons: DataFrame, synapses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first node of each content, values clamped, and only edges whose ends remain."""
    by = Window.partitionBy("index_id", "content").orderBy("created_at", "neuron_id")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    n = neurons.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").withColumn("energy", unit(F.col("energy")))
    return n, without_dangling(synapses, n).withColumn("weight", unit(F.col("weight")))
