"""Near-duplicates by SimHash, then by Jaccard similarity of word shingles, exact at the threshold.

A text is the set of hashes of its word 5-shingles. Its SimHash is taken of them, and the blocks of
``simhash.links`` name the pairs that are nearest. Texts that are similar at 0.8 differ in some ten bits
of 64, which no blocks can find, so prefixes name the rest. Put in one order for all texts, the hashes of two
texts that are similar at ``least`` or more share at least one in each other's prefix of
``n - ceil(least * n) + 1``, whatever the order is (prefix filtering, Chaudhuri et al. 2006), so no
similar pair is missed. The order puts shingles last that are common in a sample of texts, which keeps
prefixes rare; it decides how much is compared, never what is found. Each candidate pair, of either kind,
is verified on the whole sets; a bitmap of parities, a thirtieth of their size, drops most that can't be
similar before any set travels.

Copies are folded to one text, by a 64-bit hash, before anything is compared. Texts of one prefix
shingle are first verified against a pivot, which links a large group in linear work; only pairs that
are not in one component by then are tested one by one.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import simhash
from recall_spark.llm.common import cut, may_hold, settled, small_batches, survivors, text_hash, written
from recall_spark.llm.graph import connected_components

SEED = 42
SHINGLE = 5
#: Least similarity of near-duplicates, in thousandths.
LEAST = 800
#: Texts in the sample that orders shingles, in how many of them a shingle is common, and how many such count.
_SAMPLE, _COMMON, _MOST = 8_000, 3, 100_000
#: Different pivots a group of texts that share many shingles can have.
_PIVOTS = 4


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 ``text``; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """As many of ``hashes``, rarest first, as a similar text can't all lack; ``counts`` are those of sorted ``common`` ones."""
    n = len(hashes)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")][: n - -(-least * n // 1000) + 1]


def _shared(x: pa.Array, y: pa.Array) -> pa.Array:
    """How many values two lists of distinct values share, row by row."""
    xs, ys, xo, yo = x.values.to_numpy(), y.values.to_numpy(), x.offsets.to_numpy(), y.offsets.to_numpy()
    return pa.array([len(np.intersect1d(xs[a:b], ys[c:d], assume_unique=True)) for a, b, c, d in zip(xo, xo[1:], yo, yo[1:])], pa.int64())


def _sets(size: int):
    def found(text: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), size) for x in text], pa.list_(pa.int64()))

    found.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(found, "array<long>")


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    share = max(1, texts.count() // _SAMPLE)
    some = texts.where(F.pmod("node", F.lit(share)) == 0).select("node", F.explode(_sets(size)("t")).alias("key")).distinct()
    rows = some.groupBy("key").count().where(F.col("count") >= _COMMON).orderBy(F.desc("count"), "key").limit(_MOST).collect()
    rows.sort(key=lambda x: x["key"])
    return np.array([x["key"] for x in rows], np.int64), np.array([x["count"] for x in rows], np.int64)


def _close(least: int) -> Column:
    lo, hi = F.least("n", "m"), F.greatest("n", "m")
    return lo * 1000 >= hi * least


def parities(hashes: np.ndarray) -> np.ndarray:
    """How often each value of the hashes' lowest bits occurs, modulo 2, as a bitmap of two to four bits a hash."""
    size = 64
    while size < 2 * len(hashes):
        size *= 2
    odd = (np.bincount(hashes & (size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _unlike(x: pa.Array, y: pa.Array) -> pa.Array:
    """In how many values two sets differ at least, row by row, by their ``parities``: a value that is in
    both changes no bit. The longer bitmap is folded to the other's size."""
    xs, ys, xo, yo = x.values.to_numpy(), y.values.to_numpy(), x.offsets.to_numpy(), y.offsets.to_numpy()
    found = []
    for a, b, c, d in zip(xo, xo[1:], yo, yo[1:]):
        p, q = sorted((xs[a:b], ys[c:d]), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        found.append(int(np.bitwise_count((p ^ q).view(np.uint64)).sum()))
    return pa.array(found, pa.int64())


def _similar(pairs: DataFrame, own: DataFrame, texts: DataFrame, size: int, least: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts' sets have a Jaccard similarity of ``least`` or more.

    A pair whose ``parities`` differ in more bits than such sets can is dropped first. Only texts that are
    in a pair by then are made into sets and travel.
    """

    def both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        # Both joins shuffle ``of`` by one plan, so that Spark does it once.
        first = pairs.select("a", "b").join(of, F.col("a") == F.col("node")).select("a", "b", *[F.col(c).alias(f"x_{c}") for c in columns])
        return first.join(of, F.col("b") == F.col("node")).select("a", "b", *[f"x_{c}" for c in columns], *[F.col(c).alias(f"y_{c}") for c in columns])

    def once(of: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
        met = of.join(nodes, F.col("node") == F.col("hash"), "left_semi")
        return written(met.groupBy("node").agg(*[F.first(c).alias(c) for c in columns]))

    def named(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select(F.explode(F.array("a", "b")).alias("hash")).distinct())

    def likely() -> DataFrame:
        nodes = named(pairs)
        maps = once(own.where(may_hold(nodes)(F.col("node"))).select("node", "n", "map"), nodes, "n", "map")
        met = both(pairs, maps, "n", "map").select("a", "b", (F.col("x_n") + F.col("y_n")).alias("sum"), F.arrow_udf(_unlike, "long").asNondeterministic()("x_map", "y_map").alias("d"))
        return met.where(F.col("d") * (1000 + least) <= F.col("sum") * (1000 - least)).select("a", "b")

    def equal() -> DataFrame:
        nodes = named(left)
        sets = once(texts.where(may_hold(nodes)(F.col("node"))).select("node", _sets(size)("t").alias("set")), nodes, "set")
        met = both(left, sets, "set").select("a", "b", (F.size("x_set") + F.size("y_set")).alias("sum"), F.arrow_udf(_shared, "long").asNondeterministic()("x_set", "y_set").alias("n"))
        return met.where(F.col("n") * 1000 >= (F.col("sum") - F.col("n")) * least).select("a", "b")

    pairs = cut(pairs)
    left = settled(texts.sparkSession, likely)
    return settled(texts.sparkSession, equal)


def _by_simhash(own: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes by SimHash's blocks: the least of each fingerprint with the others of it,
    and with the least of each fingerprint at ``simhash.MAX_BITS`` bits or fewer."""
    first = cut(own.groupBy("print").agg(F.min("node").alias("least")))
    near = simhash.links(first.select(F.col("print").alias("fingerprint")))
    far = near.join(first, F.col("a") == F.col("print")).select("b", F.col("least").alias("x"))
    far = far.join(first, F.col("b") == F.col("print")).select("x", F.col("least").alias("y"))
    same = own.join(first, "print").where(F.col("node") > F.col("least")).select(F.col("node").alias("x"), F.col("least").alias("y"))
    return far.unionByName(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def links(texts: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Edges ``(a, b)`` that connect the nodes of ``texts(node, t)`` exactly as all pairs at ``least`` would.

    Rows of one node have one text.
    """
    common, counts = _common(texts, size)

    def first(text: pa.Array) -> pa.Array:
        sets = [shingles(x.as_py(), size) for x in text]
        parts = {
            "n": pa.array([len(x) for x in sets], pa.int64()),
            "print": pa.array([simhash.of_hashes(x) for x in sets], pa.int64()),
            "map": pa.array([parities(x) for x in sets], pa.list_(pa.int64())),
            "prefix": pa.array([prefix(x, common, counts, least) for x in sets], pa.list_(pa.int64())),
        }
        return pa.StructArray.from_arrays(list(parts.values()), names=list(parts))

    first.__annotations__ = {"text": pa.Array, "return": pa.Array}
    made = F.arrow_udf(first, "struct<n:long,print:long,map:array<long>,prefix:array<long>>")("t").alias("p")
    # Read several times: texts are made into sets once.
    own = written(texts.select("node", made).select("node", "p.*"))
    nearest = _similar(_by_simhash(own), own, texts, size, least)
    keyed = own.select("node", "n", F.explode("prefix").alias("key"))
    # Only keys that two rows may have travel with their texts.
    twice = keyed.select(F.col("key").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("hash")
    keyed = cut(keyed.where(may_hold(twice)(F.col("key"))).distinct())
    again = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = cut(keyed.join(again, "key"))
    turn = F.xxhash64("node", F.pmod("key", F.lit(_PIVOTS)))
    pivots = shared.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "n")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"))
    stars = shared.join(pivots, "key").where((F.col("node") != F.col("pivot")) & _close(least))
    stars = cut(stars.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
    linked = nearest.unionByName(_similar(stars, own, texts, size, least))
    roots = connected_components(linked).withColumnRenamed("root", "_root")
    held = shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("_root", "node").alias("root"))
    split = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    held = cut(held.join(split, "key"))
    other = held.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    rest = held.withColumnRenamed("node", "a").join(other, "key").where((F.col("root") < F.col("other")) & _close(least))
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    return linked.unionByName(_similar(rest, own, texts, size, least))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """One row of ``docs`` for each component of texts that are similar at ``least`` thousandths or more:
    the least id's, a null id only where there is no other."""
    text = F.col(f"`{text_col}`")
    texts = small_batches(docs).select(text_hash(text).alias("node"), text.cast("binary").alias("t"))
    roots = settled(docs.sparkSession, lambda: connected_components(links(texts, size, least)))
    return survivors(docs, text_hash(text), roots, id_col)
