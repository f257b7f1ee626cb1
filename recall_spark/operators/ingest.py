"""Writing memories: validate, fold repeats into fires, place, embed, label and append."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark import schema
from recall_spark.config import EngineConfig
from recall_spark.functions import sentiment as S
from recall_spark.functions import text as X
from recall_spark.operators import dynamics, spatial


class Written(NamedTuple):
    """The node table after a write, the fire events it makes, and the rows it turned down with why."""

    neurons: DataFrame
    fires: DataFrame
    rejected: DataFrame


def validated(rows: DataFrame, most: int = 64 * 1024) -> tuple[DataFrame, DataFrame]:
    """Rows with usable content, and the others with a ``reason`` code."""
    good = X.valid_content(F.col("content"), most)
    reason = F.when(F.octet_length("content") > most, "PAYLOAD_TOO_LARGE").otherwise("INVALID_CONTENT")
    return rows.where(good), rows.where(~good).withColumn("reason", reason)


def deduplicated(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New contents (the first of each by ``seq``), and how often each known or repeated one fires:
    ``(index_id, content_hash, fires)``."""
    hashed = rows.withColumn("content_hash", X.content_hash(F.col("content")))
    by = Window.partitionBy("index_id", "content_hash").orderBy("seq")
    known = existing.select("index_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    counted = hashed.withColumn("_n", F.row_number().over(by)).join(known, ["index_id", "content_hash"], "left")
    new = counted.where("_known is null and _n = 1").drop("_known", "_n")
    again = counted.where("_known or _n > 1").groupBy("index_id", "content_hash").agg(F.count(F.lit(1)).alias("fires"))
    return new, again


def nearest_by_words(new: DataFrame, existing: DataFrame, parts: int = 32) -> DataFrame:
    """``(index_id, content_hash, nearest_id, overlap)``: the existing node that shares the largest
    part of its words with each new content; of equal ones the one with the last id.

    An index's nodes are dealt into ``parts`` groups and its new contents meet each of them. A group
    keeps its new contents as lists of those that have a word, adds these up node by node, and gives on
    one best node for each: pairs are counted, never made into rows.
    """
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    left = new.select("index_id", "content_hash", words(F.col("content")).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = existing.select("index_id", "neuron_id", words(F.col("content")).alias("words"), F.pmod(F.xxhash64("neuron_id"), F.lit(parts)).cast("int").alias("part"))
    found = left.groupBy("index_id", "part").cogroup(right.groupBy("index_id", "part")).applyInArrow(_nearest, "index_id string, content_hash string, neuron_id string, s double")
    return found.groupBy("index_id", "content_hash").agg(F.max(F.struct("s", "neuron_id")).alias("b")).select("index_id", "content_hash", F.col("b.neuron_id").alias("nearest_id"), F.col("b.s").alias("overlap"))


def _nearest(new: pa.Table, nodes: pa.Table) -> pa.Table:
    hashes, n = new.column("content_hash").to_pylist(), new.num_rows
    own = new.column("words").to_pylist()
    lists: dict[str, tuple[list[int], list[int]]] = {}
    for i, words in enumerate(own):
        for w, times in Counter(words).items():
            at, often = lists.setdefault(w, ([], []))
            at.append(i)
            often.append(times)
    having = {w: (np.array(a, np.int64), np.array(t, np.float64)) for w, (a, t) in lists.items()}
    sizes = np.array([len(w) for w in own], np.int64)
    best, who = np.zeros(n), [None] * n
    ids = nodes.column("neuron_id").to_pylist()
    for k in sorted(range(len(ids)), key=lambda k: ids[k] or ""):
        words = nodes.column("words")[k].as_py() or []
        met = [having[w] for w in set(words) if w in having]
        if not met:
            continue
        both = np.bincount(np.concatenate([a for a, _ in met]), np.concatenate([t for _, t in met]), n)
        share = both / np.maximum(sizes, len(words))
        # In order of ids, so that of equal shares the last id stays.
        for i in np.flatnonzero((share >= best) & (share > 0)):
            best[i], who[i] = share[i], ids[k]
    kept = [i for i in range(n) if who[i] is not None]
    index = new.column("index_id").to_pylist()
    columns = [[index[i] for i in kept], [hashes[i] for i in kept], [who[i] for i in kept], [float(best[i]) for i in kept]]
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["index_id", "content_hash", "neuron_id", "s"])


def write(existing: DataFrame, rows: DataFrame, as_of: Column, config: EngineConfig | None = None, embedder=None, seed: int = 0) -> Written:
    """Write ``rows(index_id, seq, content, parent_id, metadata, tags)`` into ``existing`` neurons.

    Repeated content fires the node that holds it. New nodes beyond an index's capacity are turned
    down. A node's place is near its parent, else near the node with most words in common, else random
    by hash. Nodes of one batch don't see each other as parents or neighbours.
    """
    cfg = config or EngineConfig()
    for name, kind in (("parent_id", "string"), ("metadata", "map<string,string>"), ("tags", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    good, bad = validated(rows, cfg.max_content_bytes)
    new, again = deduplicated(good, existing)
    sizes = existing.groupBy("index_id").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy("index_id").orderBy("seq")
    sized = new.join(sizes, "index_id", "left").withColumn("_at", F.coalesce("_size", F.lit(0)) + F.row_number().over(order))
    full = sized.where(F.col("_at") > cfg.max_neurons)
    fits = sized.where(F.col("_at") <= cfg.max_neurons)

    places = existing.select("index_id", "neuron_id", "position")
    parents = places.select("index_id", F.col("neuron_id").alias("parent_id"), F.col("position").alias("_parent"))
    near = nearest_by_words(fits, existing).join(places.withColumnRenamed("neuron_id", "nearest_id"), ["index_id", "nearest_id"]).select("index_id", "content_hash", F.col("position").alias("_near"))
    dims = spatial.dimension(F.col("_at"), cfg.min_dimension, cfg.max_dimension)
    key = F.concat_ws("/", "index_id", "content_hash")
    spot = (
        F.when(F.col("_parent").isNotNull(), spatial.near(F.col("_parent"), key, 0.1, seed))
        .when(F.col("_near").isNotNull(), spatial.near(F.col("_near"), key, 0.2, seed))
        .otherwise(spatial.random_position(key, dims, seed))
    )
    placed = fits.join(parents, ["index_id", "parent_id"], "left").join(near, ["index_id", "content_hash"], "left").withColumn("position", spatial.resized(spot, dims, key, seed))
    fresh = placed.select(
        "index_id",
        F.col("content_hash").alias("neuron_id"),
        "content",
        "content_hash",
        "position",
        F.lit(1.0).alias("energy"),
        F.lit(0.1).alias("base_energy"),
        F.lit(0).alias("depth"),
        as_of.alias("created_at"),
        as_of.alias("last_fired_at"),
        as_of.alias("last_decay_at"),
        F.lit(1).cast("long").alias("access_count"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    fresh = S.analysed(fresh) if cfg.sentiment_enabled else fresh.withColumns({"sentiment_label": F.lit(""), "sentiment_score": F.lit(0.0)})
    fresh = embedder.embed(fresh) if embedder is not None and cfg.vector_enabled else fresh.withColumn("embedding", F.lit(None).cast("array<float>"))

    names = [c.split()[0] for c in schema.NEURONS_DDL.split(", ")]
    both = existing.select(*names).unionByName(fresh.select(*names))
    hit = both.join(again, ["index_id", "content_hash"], "left")
    n = F.coalesce("fires", F.lit(0).cast("long"))
    fired = hit.withColumns(
        {
            "energy": F.when(n > 0, dynamics.fire(F.col("energy"), n)).otherwise(F.col("energy")),
            "access_count": F.col("access_count") + n,
            "last_fired_at": F.when(n > 0, as_of).otherwise(F.col("last_fired_at")),
        }
    )
    events = hit.where("fires > 0").select("index_id", "neuron_id", as_of.alias("ts"), "fires").unionByName(fresh.select("index_id", "neuron_id", as_of.alias("ts"), F.lit(1).cast("long").alias("fires")))
    rejected = bad.select("index_id", "seq", "reason").unionByName(full.select("index_id", "seq", F.lit("CONFLICT").alias("reason")))
    return Written(fired.select(*names), events, rejected)
