"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``BINS`` equal stretches of the 64-bit key hash. Each shard owns ``vnodes`` points on
it; a key belongs to the next point clockwise. A shard takes keys up to its capacity; keys that
find it full go on clockwise to the next point whose shard has room. With ``slack`` 0 the capacities
add up to the number of keys, so shard sizes differ by at most one; with more slack fewer keys move.

Only the number of keys in each bin, a table of fixed size, comes to the driver; it decides which
ranks of which bin go to which shard. Rows are ranked within their bin, which spreads any number of
rows over ``BINS`` independent sorts, and look their segment up in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 14
BINS = 1 << BITS


def points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(bin, shard)`` of all virtual nodes, clockwise. A shard's points don't depend on the others."""
    return sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) % BINS, s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def segments(counts: dict[int, int], shards: int, vnodes: int = 128, slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """``(bin, first rank, end rank, shard)``: where the keys of each bin go.

    First every bin fills the shard that owns it, in ring order; then what was too much walks on.
    """
    ring = points(shards, vnodes)
    room = capacities(sum(counts.values()), shards, slack)
    out, late, at = [], [], 0
    for b in range(BINS):
        while at < len(ring) and ring[at][0] < b:
            at += 1
        n = counts.get(b, 0)
        owner = ring[at % len(ring)][1]
        take = min(n, room[owner])
        room[owner] -= take
        if take:
            out.append((b, 0, take, owner))
        if take < n:
            late.append((b, take, n, at % len(ring)))
    for b, done, n, at in late:
        while done < n:
            shard = ring[at % len(ring)][1]
            take = min(n - done, room[shard])
            room[shard] -= take
            if take:
                out.append((b, done, done + take, shard))
            done += take
            at += 1
    return sorted(out)


def assign(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``docs``.

    ``slot`` numbers a shard's rows from 0 without gaps. A row's key on the ring is its id as text, null
    like any other, and its text, so rows that share an id are spread like others; only rows alike in
    both share a bin, and are ranked by size and checksum. Each has a slot of its own.
    A null text has size 1 and checksum 0. An empty table gives an empty result.
    """
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`"))
    spot = lambda df: df.withColumn("bin", (F.shiftright("h", 64 - BITS) + F.lit(BINS // 2)).cast("int"))
    counts = {r.bin: r.n for r in spot(docs.select(key.alias("h"))).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = [0] * shards
    rows = []
    for b, a, z, s in segments(counts, shards, vnodes, slack):
        rows.append({"b": b, "a": a, "z": z, "shard": s, "start": start[s] - a})
        start[s] += z - a
    kind = "array<struct<b:int,a:bigint,z:bigint,shard:int,start:bigint>>"
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = spot(docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("h")))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy("h", "id", "size", "text_crc32")) - 1)
    # At most BINS rows plus one for each place where a shard ran full: a bounded broadcast.
    found = ranked.join(F.broadcast(plan), (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z")))
    return found.select("id", "size", "text_crc32", "shard", (F.col("rank") + F.col("start")).cast("long").alias("slot"))
