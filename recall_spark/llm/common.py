"""Shared by the corpus operators: reading tables, cutting lineage, hiding a caller's columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's and Java's name for the white space that separates words here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="recall-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so lost executors recompute nothing above."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table in the shared folder: for texts, and for what is read in parts."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """A folder taken away, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Takes away the tables that are ``written`` inside, for a caller who has written the result by then."""
    before = len(_WRITTEN)
    yield
    for path in _WRITTEN[before:]:
        removed(spark, path)
    del _WRITTEN[before:]


def settled(spark: SparkSession, made: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``keep(made())``, ``cut`` or ``written``, without the tables that are ``written`` on the way: the
    result is computed by then and reads none of them."""
    before = len(_WRITTEN)
    frame = made()
    last = len(_WRITTEN)
    done = keep(frame)
    for path in _WRITTEN[before:last]:
        removed(spark, path)
    del _WRITTEN[before:last]
    return done


#: Session settings that bound an Arrow batch of whole texts, and Spark's own values of them.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000")}


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches made small enough for whole texts: two tasks' batches
    and what comes back stay off-heap at once. A setting that the user has changed is left alone."""
    conf = docs.sparkSession.conf
    for key, (own, usual) in _BATCHES.items():
        if conf.get(key, usual) == usual:
            conf.set(key, own)
    return docs


def whole_row(docs: DataFrame, name: str = "_row") -> Column:
    """All of the caller's columns as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def text_hash(text: Column) -> Column:
    """Which text a row has; a null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


#: 64-bit words of a bitmap: 2 MB.
SLOTS = 1 << 18


def may_hold(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test whether a 64-bit hash may be among ``hashes(hash)``, by one bit of it in a bitmap of fixed size.

    The bits are combined before the shuffle, one task puts at most ``SLOTS`` words in order, and the
    bitmap is a scalar subquery, so nothing that grows is broadcast. It spares shuffles and decides
    nothing: what passes is looked up exactly. Not for use inside lambdas.
    """
    slot = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash")))
    words = hashes.groupBy(slot(F.col("hash")).alias("slot")).agg(F.bit_or(one).alias("word"))
    none = hashes.sparkSession.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("word"))
    every = words.unionByName(none).groupBy("slot").agg(F.bit_or("word").alias("word"))
    held = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "word"))), lambda x: x["word"]).alias("words")).scalar()
    return lambda h: F.call_function("getbit", F.get(held, slot(h)), bit(h)) == 1


def survivors(docs: DataFrame, node: Column, roots: DataFrame, id_col: str) -> DataFrame:
    """One row of ``docs`` for each component of nodes: its least id's, then least node's.

    ``node`` says which text a row has, ``roots(node, root)`` which component a node is in if not its
    own. Rows are chosen by id and node, so other texts under an id, null or not, are left alone. Null
    ids come last. Of rows with equal id and node the one least by hash stays. Rows of a node that is
    linked to none and has no other row pass without a shuffle.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), node.alias("_node"), whole_row(docs))
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_node").alias("node")))
    texts = cut(rows.groupBy("_node").agg(F.count(F.lit(1)).alias("n"), best.alias("best")))
    grouped = roots.select(F.explode(F.array("node", "root")).alias("hash")).unionByName(texts.where("n > 1").select(F.col("_node").alias("hash")))
    touched = may_hold(cut(grouped.distinct()))(F.col("_node"))
    rooted = texts.join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left")
    chosen = rooted.groupBy(F.coalesce("root", "_node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.id").alias("id"), "best.node")
    met = rows.where(touched).join(chosen, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_node") == F.col("node"))).select("_id", "_node", "_row")
    one = met.groupBy("_id", "_node").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    every = rows.where(~touched).select("_row").unionByName(one)
    return every.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def sum_hash(df: DataFrame) -> tuple:
    """Row count and an order-free hash of all rows: equal before and after at a fixed point."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
