"""Engine tables derived from the tables at hand, by integer arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each turn; a conversation is an index."""
    hours = "cast((conv_id * 5 + turn * 3) % 200 as int)"
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('conv-', conv_id) as index_id",
        "concat(conv_id, ':', turn) as neuron_id",
        "text as content",
        "0.1D + 0.9D * ((conv_id * 7 + turn * 13) % 100) / 100D as energy",
        "0.1D as base_energy",
        "cast(turn % 4 as int) as depth",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, 2 * {hours} + 1) as created_at",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, {hours}) as last_fired_at",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, {hours}) as last_decay_at",
        "1 + (conv_id + turn) % 25 as access_count",
        "array(role) as tags",
        "array(conv_id % 7 / 7D, turn % 5 / 5D, 0.5D) as position",
        "map('thread_id', cast(conv_id as string), 'role', role) as metadata",
    )


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each document; a language is an index. Some have a vector."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents")
    return docs.join(vectors, docs.doc_id == vectors.vec_id, "left").selectExpr(
        "lang as index_id",
        "cast(doc_id as string) as neuron_id",
        "text as content",
        "0.1D + 0.9D * ((doc_id * 7) % 100) / 100D as energy",
        "0.1D as base_energy",
        "cast(doc_id % 4 as int) as depth",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, cast(2 * (doc_id % 200) + 1 as int)) as created_at",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, cast(doc_id % 200 as int)) as last_fired_at",
        "1 + doc_id % 25 as access_count",
        "map('source', source) as metadata",
        "embedding",
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edges for each document, to later ids, with weights by arithmetic; one index for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 7, 31)])).alias("k")).selectExpr(
        "'all' as index_id",
        "concat(doc_id, ':', doc_id + k) as synapse_id",
        "cast(doc_id as string) as from_id",
        "cast(doc_id + k as string) as to_id",
        "0.1D + 0.9D * ((doc_id * 3 + k * 11) % 50) / 50D as weight",
        "1 + (doc_id + k) % 9 as co_fire_count",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, cast((doc_id + k) % 50 as int)) as last_co_fire",
        f"timestamp_ntz'{AS_OF}' - make_dt_interval(0, cast(50 + (doc_id * k) % 1000 as int)) as created_at",
    )


def fires(spark: SparkSession, sf_dir: str, per_type: bool = False) -> DataFrame:
    """Fire events of neurons named by user, in one index or one for each event type."""
    index = "event_type" if per_type else "'all'"
    return table(spark, sf_dir, "events").selectExpr(f"{index} as index_id", "cast(user_id as string) as neuron_id", "ts", "event_id as seq")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of indexes named by user."""
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as index_id", "ts")
