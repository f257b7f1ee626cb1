"""A training-corpus pipeline in five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and reread as the next
one's ``docs``. All stages but the last return the columns of ``documents``, and any more that came with
them, whatever their names. A null text counts as empty, so the quality rules reject it; rows may have no
id or share one; repeated rows are judged alike until near-duplicates keep one of them; an empty table
gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.llm import bpe, decontam, linededup, neardup, quality
from recall_spark.llm.common import checkpoint_dir, removed, scratch, table
from recall_spark.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text has. What lost passages and is then under the quality
    rules' least number of words goes, as it would have gone at the stage before."""
    return linededup.cleaned(docs, min_words=quality.MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group whose word 5-shingles are similar at 0.8 or more."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    found = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", tokenized),
]

#: Banded alignment, components and byte-pair merges are beyond SQL; tests hold it to a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and reread. What a stage read
    and wrote on its way is taken away once its rows are there."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")
    return docs
