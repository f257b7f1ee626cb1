"""Structured Streaming forms of learning and lifecycle, with keyed state for each index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recall_spark import schema

LEARNED_DDL = "index_id string, synapse_id string, from_id string, to_id string, weight double, co_fire_count bigint, last_us bigint, created_us bigint"
LIFECYCLE_DDL = "index_id string, last_us bigint, invoke_count bigint, session_us bigint"


def fires_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Fire events from a folder of Parquet files with the columns of ``FIRES_DDL``."""
    return spark.readStream.schema(schema.FIRES_DDL).option("maxFilesPerTrigger", files).parquet(path)


class CoActivation(StatefulProcessor):
    """Edges of one index: recent fires, weights and degrees are map states, so an update touches only
    the keys it changes. Events of one batch are taken by time and sequence number."""

    def __init__(self, window: float = 5.0, rate: float = 0.1, initial: float = 0.2, most: int = 50) -> None:
        self.width, self.rate, self.initial, self.most = int(window * 1_000_000), rate, initial, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "neuron_id string", "us bigint")
        self.edges = handle.getMapState("edges", "from_id string, to_id string", "weight double, n bigint, last bigint, created bigint")
        self.degree = handle.getMapState("degree", "neuron_id string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        recent = {k[0]: v[0] for k, v in self.recent.iterator()}
        changed: dict[tuple[str, str], tuple[float, int, int, int]] = {}
        for neuron, now in zip(events["neuron_id"], events["us"].astype("int64")):
            now = int(now)
            for other in [o for o, at in recent.items() if o != neuron and now - at <= self.width]:
                edge = self._strengthen(neuron, other, now)
                if edge:
                    changed[edge[0]] = edge[1]
            recent[neuron] = now
            recent = {o: at for o, at in recent.items() if now - at <= 2 * self.width}
        self.recent.clear()
        for k, v in recent.items():
            self.recent.updateValue((k,), (v,))
        out = [(key[0], f"{a}:{b}", a, b, *v) for (a, b), v in changed.items()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEARNED_DDL.split(", ")])

    def _strengthen(self, a: str, b: str, now: int):
        pair = (min(a, b), max(a, b))
        if self.edges.containsKey(pair):
            w, n, _, created = self.edges.getValue(pair)
            value = (w + self.rate * (1 - w), n + 1, now, created)
        else:
            degree = {x: self.degree.getValue((x,))[0] if self.degree.containsKey((x,)) else 0 for x in pair}
            if max(degree.values()) >= self.most:
                return None
            for x, n in degree.items():
                self.degree.updateValue((x,), (n + 1,))
            value = (self.initial, 1, now, now)
        self.edges.updateValue(pair, value)
        return pair, value

    def close(self) -> None:
        pass


def learned(fires: DataFrame, window: float = 5.0, rate: float = 0.1, initial: float = 0.2, most: int = 50) -> DataFrame:
    """A stream of edge updates; the last row of an edge is its state."""
    timed = fires.select("index_id", "neuron_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq")
    return timed.groupBy("index_id").transformWithStateInPandas(CoActivation(window, rate, initial, most), LEARNED_DDL, "Update", "None")


class Lifecycle(StatefulProcessor):
    """Last activity, number of calls and session start of one index; a pause long enough to fall asleep
    starts a new session."""

    def __init__(self, sleep: float = 300) -> None:
        self.sleep = int(sleep * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "last bigint, n bigint, session bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, session = self.now.get() if self.now.exists() else (None, 0, None)
        for us in sorted(int(x) for part in rows for x in part["us"]):
            if last is None or us - last > self.sleep:
                session = us
            last, n = us if last is None else max(last, us), n + 1
        self.now.update((last, n, session))
        yield pd.DataFrame([(key[0], last, n, session)], columns=[c.split()[0] for c in LIFECYCLE_DDL.split(", ")])

    def close(self) -> None:
        pass


def lifecycle(activity: DataFrame, sleep: float = 300) -> DataFrame:
    """A stream of each index's last activity, count and session start. Its state at any moment is a
    function of the time since (``operators.lifecycle.state``)."""
    timed = activity.select("index_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("index_id").transformWithStateInPandas(Lifecycle(sleep), LIFECYCLE_DDL, "Update", "None")


def sessions(activity: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by event time; late events within the watermark still merge."""
    marked = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("index_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ops")).select("index_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "ops")


def activity_counts(activity: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    marked = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("index_id", F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("ops")).select("index_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "ops")


def coalesced(batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key in a batch, columns as they were."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), seq).alias("_last"))
    return last.select("_last.*")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process all that is there with ``foreachBatch`` and stop; state lives in RocksDB."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
