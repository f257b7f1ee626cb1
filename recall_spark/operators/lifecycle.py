"""Lifecycle of indexes from their activity: states, sparseness, sessions, eviction, rate limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recall_spark.operators.dynamics import seconds_between

STATES = ("active", "idle", "sleeping", "dormant")


def state(elapsed: Column, idle: float = 30, sleep: float = 300, dormant: float = 1800) -> Column:
    """State after that many seconds without activity; null, an unknown index, is dormant."""
    return F.when(elapsed.isNull() | (elapsed > dormant), "dormant").when(elapsed > sleep, "sleeping").when(elapsed > idle, "idle").otherwise("active")


def states(activity: DataFrame, as_of: Column, **thresholds: float) -> DataFrame:
    last = activity.groupBy("index_id").agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("invoke_count"))
    return last.withColumn("state", state(seconds_between(as_of, F.col("last_activity")), **thresholds))


def distribution(found: DataFrame) -> DataFrame:
    """One row with a count for each state, zero where there is none."""
    return found.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def awake(neurons: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of active and idle indexes."""
    return neurons.join(found.where(F.col("state").isin("active", "idle")).select("index_id"), "index_id", "left_semi")


def asleep(neurons: DataFrame, found: DataFrame) -> DataFrame:
    return neurons.join(found.where(F.col("state") == "sleeping").select("index_id"), "index_id", "left_semi")


def sparseness(activity: DataFrame, window: int = 30, least: int = 3) -> DataFrame:
    """Operations in the trailing window at each one, and whether they are few."""
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    by = Window.partitionBy("index_id").orderBy("epoch").rangeBetween(-window, 0)
    out = activity.withColumn("epoch", epoch).withColumn("recent_ops", F.count(F.lit(1)).over(by))
    return out.withColumn("sparse", F.col("recent_ops") < least).drop("epoch")


def sessions(activity: DataFrame, gap: float = 300) -> DataFrame:
    """Runs of activity with no pause over ``gap`` seconds."""
    by = Window.partitionBy("index_id").orderBy("ts")
    new = F.coalesce((seconds_between(F.col("ts"), F.lag("ts").over(by)) > gap).cast("int"), F.lit(1))
    numbered = activity.withColumn("new", new).withColumn("session", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("index_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("ops"))


def evicted(activity: DataFrame, as_of: Column, idle: float = 1800) -> DataFrame:
    """Indexes whose last operation is longer ago than ``idle`` seconds."""
    last = activity.groupBy("index_id").agg(F.max("ts").alias("last_op"), F.count(F.lit(1)).alias("ops_processed"))
    return last.where(seconds_between(as_of, F.col("last_op")) > idle)


def pool_stats(activity: DataFrame, as_of: Column, idle: float = 1800) -> DataFrame:
    last = activity.groupBy("index_id").agg(F.max("ts").alias("last_op"), F.count(F.lit(1)).alias("ops"))
    gone = seconds_between(as_of, F.col("last_op")) > idle
    return last.agg(F.count_if(~gone).alias("active_workers"), F.count(F.lit(1)).alias("total_created"), F.count_if(gone).alias("total_evicted"), F.sum("ops").alias("total_ops"))


def rate_limited(requests: DataFrame, limit: int, window: float = 60) -> DataFrame:
    """Requests over ``limit`` in their client's window. A window begins at the first request after the
    one before has run out.

    Where a window begins depends on where the one before did, so each client's requests are passed in
    order: sorted by Spark, which may spill, and read as a stream that keeps one client's window.
    """
    rows = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    order = rows.repartition("client").sortWithinPartitions("client", "us", "request_id")
    kept = StructType([*requests.schema.fields, StructField("n", LongType())])
    over = order.mapInArrow(_counted(round(window * 1_000_000)), StructType([*rows.schema.fields, StructField("n", LongType())]))
    return over.where(F.col("n") > limit).select(*[f.name for f in kept])


def _counted(window: int):
    """Appends to each request its number in its client's window."""

    def run(batches):
        client, start, n = None, None, 0
        for part in batches:
            out = []
            for who, us in zip(part.column("client").to_pylist(), part.column("us").to_pylist()):
                if start is None or who != client or us - start >= window:
                    client, start, n = who, us, 0
                n += 1
                out.append(n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], names=[*part.schema.names, "n"])

    return run
