"""The periodic jobs as functions over a store, and a stream that drives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recall_spark.config import EngineConfig
from recall_spark.operators import dynamics, lifecycle, spatial
from recall_spark.sources.store import GraphStore


class Daemons:
    """Decay, consolidation, pruning and reorganisation; each commits once."""

    def __init__(self, store: GraphStore, activity: DataFrame, config: EngineConfig | None = None) -> None:
        self.store, self.activity, self.config = store, activity, config or EngineConfig()

    def _states(self, as_of: Column) -> DataFrame:
        c = self.config
        return lifecycle.states(self.activity, as_of, idle=c.idle_threshold, sleep=c.sleep_threshold, dormant=c.dormant_threshold)

    def decay(self, as_of: Column) -> None:
        """Energy and weights of awake indexes; weak edges go."""
        found = self._states(as_of)
        n, s = self.store.read("neurons"), self.store.read("synapses")
        awake = found.where("state in ('active', 'idle')").select("index_id")
        nodes = dynamics.decay_nodes(n.join(awake, "index_id", "left_semi"), as_of, self.config.decay_rate).unionByName(n.join(awake, "index_id", "left_anti"))
        edges = dynamics.prune_edges(dynamics.decay_edges(s.join(awake, "index_id", "left_semi"), as_of, self.config.edge_decay_rate)).unionByName(s.join(awake, "index_id", "left_anti"))
        self.store.commit({"neurons": nodes, "synapses": edges})

    def consolidate(self, as_of: Column) -> None:
        n = self.store.read("neurons")
        sleeping = self._states(as_of).where("state = 'sleeping'").select("index_id")
        deeper = dynamics.consolidate(n.join(sleeping, "index_id", "left_semi"), as_of)
        self.store.save("neurons", deeper)

    def prune(self) -> None:
        n, s = dynamics.prune(self.store.read("neurons"), self.store.read("synapses"))
        self.store.commit({"neurons": n, "synapses": s})

    def reorganise(self, as_of: Column) -> None:
        n = self.store.read("neurons")
        sleeping = self._states(as_of).where("state = 'sleeping'").select("index_id")
        moved = spatial.reorganise(n.join(sleeping, "index_id", "left_semi"), self.store.read("synapses"))
        self.store.save("neurons", moved.select(*n.columns))


def every(spark: SparkSession, seconds: float, job, checkpoint: str) -> StreamingQuery:
    """Run ``job(batch_id)`` at an interval, as the sink of a rate stream."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
