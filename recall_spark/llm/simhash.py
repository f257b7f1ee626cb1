"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most
``MAX_BITS`` (2) bits agree in at least two whole blocks, so they meet under one of six keys of two
blocks each; candidates of a key are joined and their Hamming distance is verified. Copies are
folded to one distinct fingerprint before any join.

A key shared by more than ``bucket`` distinct fingerprints is never joined with itself. Its members
go a way that is linear in their number and loses no link: each emits itself and its 64 neighbours
at one bit; two fingerprints are at most two bits apart exactly if they share such a neighbour, and
one neighbour has at most 65 members.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import cut, small_batches, survivors
from recall_spark.llm.graph import connected_components

MAX_BITS = 2
SEED = 42
SHINGLE = 3
_BLOCK = 1 << 13


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of at most ``_BLOCK`` hashes each bit is 1."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.add.reduce(bits, axis=0, dtype=np.uint16)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def of_hashes(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of 64-bit shingle hashes, of any shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += _ones(hashes[at : at + _BLOCK])
    return _majority(ones, len(hashes))


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the word 3-shingles of UTF-8 ``text``; 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        ones += _ones(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1])], np.uint64))
    return _majority(ones, n)


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x.as_py()) for x in text], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row; a null text has fingerprint 0."""
    return small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t")).select("id", F.arrow_udf(_fingerprints, "long")("t").alias("fingerprint"))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, bucket: int = 16) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints of ``distinct(fingerprint)`` at 2 bits or fewer.

    Every pair in a small key's bucket is tested; a large bucket gives star edges to the least
    member of each shared neighbour, which connect exactly what the pairs would.
    """
    f = F.col("fingerprint")
    block = [F.shiftrightunsigned(f, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[F.shiftleft(block[i], 16).bitwiseOR(block[j]) for i, j in combinations(range(4), 2)])
    keyed = distinct.select("fingerprint", F.posexplode(keys).alias("combo", "key"))
    sizes = keyed.groupBy("combo", "key").count().where("count > 1")
    shared = cut(keyed.join(sizes, ["combo", "key"]))
    small = shared.where(F.col("count") <= bucket)
    pairs = (
        small.select("combo", "key", f.alias("a"))
        .join(small.select("combo", "key", f.alias("b")), ["combo", "key"])
        .where((F.col("a") > F.col("b")) & (_distance("a", "b") <= MAX_BITS))
        .select("a", "b")
    )
    hot = shared.where(F.col("count") > bucket).select("fingerprint").distinct()
    flips = F.concat(F.array(f), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: f.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    star = (
        hot.select("fingerprint", F.explode(flips).alias("near"))
        .groupBy("near")
        .agg(F.collect_list("fingerprint").alias("members"))
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
        .where((F.col("a") > F.col("b")) & (_distance("a", "b") <= MAX_BITS))
    )
    return pairs.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 16) -> DataFrame:
    """``(id, fingerprint, component)`` for every row of ``docs``.

    ``component`` is the least id reachable over links. Null and empty texts have fingerprint 0 and
    are linked like any other; repeated rows stay and share a component; a null id stays null and
    counts towards no minimum; an empty table gives an empty result. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = connected_components(links(distinct.select("fingerprint"), bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    component = rooted.join(least, "root").select("fingerprint", "component")
    return prints.join(component, "fingerprint").select("id", "fingerprint", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 16) -> DataFrame:
    """One row of ``docs`` for each component: its least id's, a null id only where there is no other."""
    prints = cut(fingerprints(docs, id_col, text_col).select("fingerprint").distinct())
    roots = connected_components(links(prints, bucket))
    return survivors(docs, F.arrow_udf(_fingerprints, "long")(F.col(f"`{text_col}`").cast("binary")), roots, id_col)
