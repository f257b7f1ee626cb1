"""Operations over many indexes: catalog, recent activity, and merged searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.config import clamp
from recall_spark.operators import scoring


def catalog(neurons: DataFrame, synapses: DataFrame, activity: DataFrame, registry: DataFrame | None = None, active_only: bool = False, limit: int = 100) -> DataFrame:
    """Indexes with node and edge counts, last operation and registry metadata.

    ``active_only``: those with activity, whether registered or not; else all registered ones.
    """
    n = neurons.groupBy("index_id").agg(F.count(F.lit(1)).alias("neuron_count"))
    e = synapses.groupBy("index_id").agg(F.count(F.lit(1)).alias("synapse_count"))
    ops = activity.groupBy("index_id").agg(F.max("ts").alias("last_op"), F.count(F.lit(1)).alias("ops_processed"))
    reg = registry.select(F.col("uuid").alias("index_id"), "metadata", "created_at", "updated_at") if registry is not None else None
    base = ops.select("index_id") if active_only or reg is None else reg.select("index_id")
    out = base.join(ops, "index_id", "left").join(n, "index_id", "left").join(e, "index_id", "left")
    if reg is not None:
        out = out.join(reg, "index_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"active": F.col("last_op").isNotNull(), "neuron_count": F.coalesce("neuron_count", zero), "synapse_count": F.coalesce("synapse_count", zero)})
    return out.orderBy("index_id").limit(limit if limit > 0 else 100)


def recent(neurons: DataFrame, synapses: DataFrame, activity: DataFrame, limit: int = 20, min_neurons: int = 0) -> DataFrame:
    """Active indexes by last operation, newest first, with at least ``min_neurons`` nodes."""
    full = catalog(neurons, synapses, activity, active_only=True, limit=1 << 30)
    return full.where(F.col("neuron_count") >= min_neurons).orderBy(F.desc("last_op"), "index_id").limit(limit if limit > 0 else 20)


def ranking(mode: str) -> Column:
    """How merged results are ordered: ``energy_access``, ``strict`` (energy alone) or ``score``."""
    return {"energy_access": F.col("energy") * F.col("access_count"), "strict": F.col("energy"), "score": F.col("score")}[mode]


def search_all(nodes: DataFrame, query: str, as_of: Column, limit: int | None = None, mode: str = "energy_access", **options) -> DataFrame:
    """Top ``limit`` (10, at most 50) of every index, merged and cut to five times that."""
    k = clamp(limit, 10, 50)
    found = _top_each(scoring.scored(nodes, query, as_of, **options), k)
    return found.orderBy(ranking(mode).desc(), "index_id", "neuron_id").limit(5 * k)


def search_many(nodes: DataFrame, index_ids: list[str], query: str, as_of: Column, limit: int | None = None, mode: str = "energy_access", **options) -> DataFrame:
    """Top ``limit`` of each named index, merged; unknown indexes give nothing."""
    k = clamp(limit, 10, 50)
    own = nodes.where(F.col("index_id").isin(*index_ids))
    return _top_each(scoring.scored(own, query, as_of, **options), k).orderBy(ranking(mode).desc(), "index_id", "neuron_id")


def _top_each(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("index_id").orderBy(F.desc("score"), "neuron_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def grouped(results: DataFrame) -> DataFrame:
    """Results of each index as one list, in rank order."""
    return results.groupBy("index_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neuron_id"))), lambda x: x["neuron_id"]).alias("results"), F.count(F.lit(1)).alias("total"))
