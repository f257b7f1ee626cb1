"""``MemoryEngine``: the operations of the public surface as methods over DataFrames."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_spark import schema
from recall_spark.config import EngineConfig, clamp
from recall_spark.errors import IndexIDRequired, NeuronIDRequired, QueryRequired
from recall_spark.functions import text as X
from recall_spark.operators import commands, context, crossindex, dynamics, ingest, observe, scoring, spread
from recall_spark.sources.registry import Registry
from recall_spark.sources.store import GraphStore, durable

RECALL_PROMPT = "Recall what is known about: {topic}\nSearch the memory first, then answer from what it holds."


class Found(NamedTuple):
    """A search's rows, and the fire events that reading them causes."""

    result: DataFrame
    fires: DataFrame


class MemoryEngine:
    """Neurons and synapses of all indexes, or of one chosen by ``index``.

    Every read is a DataFrame and changes nothing; the fires that a read causes come beside it and are
    applied with ``apply``. Writes give a new engine.
    """

    def __init__(self, neurons: DataFrame, synapses: DataFrame, as_of: Column | None = None, config: EngineConfig | None = None, embedder=None, registry: Registry | None = None, activity: DataFrame | None = None, index_id: str | None = None) -> None:
        self.all_neurons, self.all_synapses = neurons, synapses
        self.as_of = as_of if as_of is not None else F.localtimestamp()
        self.config, self.embedder, self.registry, self.activity, self.index_id = config or EngineConfig(), embedder, registry, activity, index_id
        self.commands = commands.CommandRegistry()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> MemoryEngine:
        store = GraphStore.open(spark, path)
        return cls(store.read("neurons"), store.read("synapses"), **options)

    @classmethod
    def empty(cls, spark: SparkSession, **options: Any) -> MemoryEngine:
        return cls(spark.createDataFrame([], schema.NEURONS_DDL), spark.createDataFrame([], schema.SYNAPSES_DDL), **options)

    def _like(self, **changes: Any) -> MemoryEngine:
        own = {"neurons": self.all_neurons, "synapses": self.all_synapses, "as_of": self.as_of, "config": self.config, "embedder": self.embedder, "registry": self.registry, "activity": self.activity, "index_id": self.index_id}
        return MemoryEngine(**(own | changes))

    def index(self, index_id: str) -> MemoryEngine:
        if not (index_id or "").strip():
            raise IndexIDRequired("name an index")
        return self._like(index_id=index_id)

    def _own(self, df: DataFrame) -> DataFrame:
        return df if self.index_id is None else df.where(F.col("index_id") == self.index_id)

    @property
    def neurons(self) -> DataFrame:
        return self._own(self.all_neurons)

    @property
    def synapses(self) -> DataFrame:
        return self._own(self.all_synapses)

    # Reads.
    def read(self, neuron_id: str) -> Found:
        if not neuron_id:
            raise NeuronIDRequired("name a neuron")
        one = self.neurons.where(F.col("neuron_id") == neuron_id)
        return Found(one, self._fires(one, 2))

    def recall(self, limit: int | None = None, offset: int = 0, depth: int | None = None) -> DataFrame:
        """Nodes by energy: 100 unless told otherwise, at most 500."""
        own = self.neurons if depth is None else self.neurons.where(F.col("depth") == depth)
        return commands.page(own.orderBy(F.desc("energy"), "neuron_id"), offset, clamp(limit, 100, 500))

    def search(self, query: str, depth: int | None = None, limit: int | None = None, metadata: dict[str, str] | None = None, strict: bool = False, query_vector: list[float] | None = None, query_label: str | None = None) -> Found:
        """Ranked search with ``depth`` hops of spread activation (2, at most 8; 0 for none) and
        ``limit`` rows (20, at most 200)."""
        if not (query or "").strip():
            raise QueryRequired("a search needs text")
        k = clamp(limit, 20, 200)
        hops = 0 if depth == 0 else clamp(depth, 2, 8)
        seeds = scoring.scored(self.neurons, query, self.as_of, query_vector=query_vector, query_label=query_label, metadata=metadata, strict=strict, alpha=self.config.alpha)
        if not hops:
            out = scoring.top(seeds, k)
        else:
            seeds = durable(seeds.select("index_id", "neuron_id", "score"))
            reached = spread.spread(seeds, self.synapses, self.neurons, hops)
            met = self.neurons.join(reached, ["index_id", "neuron_id"])
            if strict and metadata:
                from recall_spark.operators.filters import metadata_matches

                for hit in metadata_matches(metadata):
                    met = met.where(hit)
            out = scoring.top(met, k)
        return Found(out, self._fires(out, 1))

    def _fires(self, rows: DataFrame, times: int) -> DataFrame:
        return rows.select("index_id", "neuron_id", self.as_of.alias("ts"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long"))).alias("seq"))

    def context(self, query: str, max_tokens: int = 2000, depth: int | None = None) -> DataFrame:
        """One text of the best memories that fit a token budget."""
        found = self.search(query, depth, context.CANDIDATES).result
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "neuron_id"))).withColumn("query", F.lit(query))
        return context.assembled(ranked, max_tokens, ["query"])

    def prompt(self, topic: str) -> str:
        return RECALL_PROMPT.format(topic=topic)

    def stats(self) -> DataFrame:
        return observe.index_stats(self.neurons, self.synapses)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return observe.graph_nodes(self.neurons), observe.graph_edges(self.synapses)

    def activity_feed(self) -> DataFrame:
        return observe.activity_feed(self.neurons, self.synapses, self.as_of)

    # Over indexes.
    def list_indexes(self, active_only: bool = False, limit: int = 100) -> DataFrame:
        return crossindex.catalog(self.all_neurons, self.all_synapses, self._activity(), self.registry.entries if self.registry else None, active_only, limit)

    def recent_indexes(self, limit: int = 20, min_neurons: int = 0) -> DataFrame:
        return crossindex.recent(self.all_neurons, self.all_synapses, self._activity(), limit, min_neurons)

    def _activity(self) -> DataFrame:
        return self.activity if self.activity is not None else self.all_neurons.select("index_id", F.col("last_fired_at").alias("ts"))

    def global_search(self, query: str, limit: int | None = None, **options: Any) -> DataFrame:
        if not (query or "").strip():
            raise QueryRequired("a search needs text")
        return crossindex.search_all(self.all_neurons, query, self.as_of, limit, **options)

    def multi_search(self, index_ids: list[str], query: str, limit: int | None = None, **options: Any) -> DataFrame:
        if not index_ids:
            raise IndexIDRequired("name at least one index")
        if not (query or "").strip():
            raise QueryRequired("a search needs text")
        return crossindex.search_many(self.all_neurons, index_ids, query, self.as_of, limit, **options)

    def registry_find_or_create(self, uuid: str, metadata: dict[str, str] | None, as_of: str) -> tuple[MemoryEngine, bool]:
        reg, made = (self.registry or Registry.empty(self.all_neurons.sparkSession)).find_or_create(uuid, metadata, as_of)
        return self._like(registry=reg), made

    # Writes.
    def write(self, rows: DataFrame | list[dict[str, Any]]) -> MemoryEngine:
        """With new memories; the write's events and rejections are in ``.written``."""
        if not isinstance(rows, DataFrame):
            kind = "index_id string, seq bigint, content string, parent_id string, metadata map<string,string>, tags array<string>"
            data = [(r.get("index_id", self.index_id), n, r.get("content"), r.get("parent_id"), r.get("metadata"), r.get("tags")) for n, r in enumerate(rows)]
            if any(d[0] is None for d in data):
                raise IndexIDRequired("name an index")
            rows = self.all_neurons.sparkSession.createDataFrame(data, kind)
        done = ingest.write(self.all_neurons, rows, self.as_of, self.config, self.embedder)
        new = self._like(neurons=done.neurons)
        new.written = done
        return new

    def apply(self, fires: DataFrame) -> MemoryEngine:
        return self._like(neurons=dynamics.apply_fires(self.all_neurons, fires))

    def touch(self, neuron_id: str, content: str) -> MemoryEngine:
        where = F.col("neuron_id") == neuron_id
        if self.index_id is not None:
            where &= F.col("index_id") == self.index_id
        return self._like(neurons=dynamics.update_content(self.all_neurons, where, F.lit(content), self.as_of))

    def forget(self, neuron_id: str) -> MemoryEngine:
        gone = self.neurons.where(F.col("neuron_id") == neuron_id).select("index_id", "neuron_id")
        n, s = dynamics.delete_nodes(self.all_neurons, self.all_synapses, gone)
        return self._like(neurons=n, synapses=s)

    def drop_index(self, index_id: str) -> MemoryEngine:
        other = F.col("index_id") != index_id
        return self._like(neurons=self.all_neurons.where(other), synapses=self.all_synapses.where(other))

    def execute(self, command: str | dict[str, Any]) -> Any:
        return self.commands.execute(self, command)

    def tokens(self) -> MemoryEngine:
        """With a ``tokens`` column, worth keeping where many searches follow."""
        return self._like(neurons=self.all_neurons.withColumn("tokens", X.tokens(F.col("content"))))
