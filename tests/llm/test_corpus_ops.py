"""Operators that compare documents with each other, and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from recall_spark.llm import decontam, graph, linededup, neardup, queries, sharding, simhash
from recall_spark.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    r = random.Random(1)
    texts = [None, "", " \n", "one", "one two", "One TWO three", "É é three", "a b c d e f g " * 3000] + [" ".join(r.choice(["a", "b", "c", "é"]) for _ in range(r.randint(0, 40))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) & (2**64 - 1) == plain_fingerprint(t)
    assert simhash.fingerprint(b"") == 0


def test_links_lose_nothing_with_any_bucket(spark):
    r = random.Random(2)
    prints = set()
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            f = base
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
            prints.add(f)
    hub = r.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    want_pairs = {(a, b) for a in signed for b in signed if a > b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    want = components(signed, want_pairs)
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    for bucket in (2, 16, 10**9):
        got = {(x.a, x.b) for x in simhash.links(df, bucket).collect()}
        assert got <= want_pairs and components(signed, got) == want
    assert {(x.a, x.b) for x in simhash.links(df, 10**9).collect()} == want_pairs


def test_near_duplicates(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(300)) for _ in range(12)]
    texts = base + [b + " tail" for b in base[:6]] + [base[0].upper(), None, "", " ", base[1], base[1]]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(3, base[3], 0, "x"), (None, base[4], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint bigint, id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = components(prints, [(a, b) for a in prints for b in prints if a > b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    assert all(x.component == want[x.id] for x in got if x.id is not None)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicated(df.limit(0)).count() == 0


def test_near_duplicate_stage_finds_all_at_similarity(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    line = [word() for _ in range(12)]
    texts = []
    for i in range(24):
        base = [word() for _ in range(150)] + (line if i % 2 else [])
        texts.append(base)
        for edits in range(1, 7):
            copy = list(base)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["one two three", "One  two three", "one two four", None, ""]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = set(components(range(len(sets)), pairs).values())
    assert len(pairs) > 50 and len(want) < 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, df, SF)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == want
    assert neardup.deduplicated(df.limit(0)).count() == 0


def test_parities_are_a_lower_bound_of_what_differs():
    r = np.random.default_rng(3)
    for n, m, both in ((1, 1, 0), (3, 40, 2), (300, 310, 290), (500, 530, 0), (5000, 4200, 4100), (64, 64, 64)):
        every = r.integers(-(1 << 62), 1 << 62, n + m - both)
        x, y = every[:n], every[n - both :]
        lists = [neardup.pa.array([neardup.parities(v)], neardup.pa.list_(neardup.pa.int64())) for v in (x, y)]
        least = neardup._unlike(*lists)[0].as_py()
        assert least <= n + m - 2 * both and (n + m - 2 * both - least) % 2 == 0
        assert least > (n + m) / 9 or 9 * both >= 4 * (n + m)


def test_operators_take_away_the_tables_they_no_longer_read(spark):
    docs = table(spark, SF, "documents")
    tables = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).glob("table-*"))
    for stage, most in ((linededup.cleaned, 1), (neardup.deduplicated, 0)):
        before = tables()
        assert stage(docs).count() > 50 and len(tables() - before) <= most


def test_near_dedup_goes_by_simhash_too(spark, monkeypatch):
    r = random.Random(8)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(900)) for _ in range(6)]
    texts = base + [b + " end" for b in base]
    prints = [simhash.of_hashes(neardup.shingles(t.encode())) for t in texts]
    apart = lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()
    want = {(max(a, b), min(a, b)) for a in range(12) for b in range(a) if apart(a, b) <= simhash.MAX_BITS}
    assert want == {(k + 6, k) for k in range(6)}
    assert {(x.a, x.b) for x in neardup._by_simhash(spark.createDataFrame(list(enumerate(prints)), "node bigint, print bigint")).collect()} == want
    asked = []
    own = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, *a: asked.append(d.count()) or own(d, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, SF).collect()} == set(range(6)) and asked == [len(set(prints))]


def test_rows_without_own_ids_are_not_lost(spark):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) + "." for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (7, c), (7, d), (7, e)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(None, a), (None, b), (1, c), (7, d), (7, e)}
    for stage in (simhash.deduplicated, neardup.deduplicated):
        kept = [tuple(x) for x in stage(df).collect()]
        assert len(kept) == len(want) and set(kept) == want
    left = {tuple(x) for x in linededup.cleaned(df).collect()}
    assert {(None, a), (None, b), (1, c), (7, d), (7, e)} <= left


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- Decontamination.
def distance(p, t):
    """Least edits between p and any part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(12)] + ["tiny", None, "", items0 := "Ünï côde pässage with, accents and more words here"]
    index = decontam.Index(items)
    texts = []
    for _ in range(120):
        i = r.randrange(12)
        s, k = list(items[i]), int(index.edits[i])
        for _ in range(r.randint(0, k + 2)):
            p, o = r.randrange(len(s)), r.randrange(3)
            s[p : p + (o != 2)] = [] if o == 1 else [r.choice("xyz")]
        texts.append(" ".join(word() for _ in range(r.randint(0, 20))) + " " + "".join(s) + " " + word())
    texts += [None, "", "x", items[0].upper(), items[1].replace(" ", " \n "), items0, items[2] + " " + items[2], "has tiny inside", "word " * 4000 + items[5]]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, start int")
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)] + [(999, items[0])], "item_id bigint, text string")
    found = decontam.leaks(docs, bench, block_chars=400).collect()
    by = defaultdict(set)
    for x in found:
        by[x.id].add(x.item_id)
        if x.edits == 0:
            assert decontam.folded(texts[x.id][x.start : x.end])[0].tolist() == index.items[x.item_id - 100].tolist()
    folded = lambda t: "".join(map(chr, decontam.folded(t or "")[0]))
    for i, t in enumerate(texts[:-1]):
        for n, item in enumerate(items):
            if item and len(item) < 8:
                assert (100 + n in by[i]) == (item in folded(t))
            elif item:
                p = "".join(map(chr, index.items[n]))
                assert (100 + n in by[i]) == (distance(p, folded(t)) <= index.edits[n]), (i, n)
    assert by[len(texts) - 1] == {105} and sum(x.id == len(texts) - 3 and x.item_id == 102 for x in found) == 2
    clean = {x.doc_id for x in decontam.clean_rows(docs, bench, block_chars=400).collect()}
    assert clean == {i for i in range(len(texts)) if not by[i]}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.clean_rows(docs, bench.limit(0)).count() == len(rows)


# -- Sharding.
def test_shards_are_balanced_and_gapless(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").limit(997).withColumn("shard", F.lit(1)).withColumn("bin", F.lit(2))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 1, 2), (5, "", 1, 2), (5, "", 1, 2)], "doc_id bigint, text string, shard int, bin int"))
    got = sharding.assign(docs, 7).collect()
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    sizes = [len(v) for v in slots.values()]
    assert len(got) == 1000 and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((x.id, x.shard, x.slot) for x in got) == Counter((x.id, x.shard, x.slot) for x in sharding.assign(docs.repartition(3), 7).collect())
    assert sharding.assign(docs.limit(0), 7).count() == 0
    null = next(x for x in got if x.id is None)
    assert (null.size, null.text_crc32) == (1, 0)


def plain_ring(keys, shards, vnodes, slack):
    """Shard and slot of each of ``keys``, hashes in order, one key at a time."""
    spot = lambda name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()) % sharding.BINS
    ring = sorted((spot(f"{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    n = len(keys)
    room = [-(-int(n * (1 + slack) * 10**9) // (shards * 10**9)) if slack else n // shards + (s < n % shards) for s in range(shards)]
    bins = [(h >> 50) + sharding.BINS // 2 for h in keys]
    home = [next((k for k, p in enumerate(ring) if p[0] >= b), 0) for b in bins]
    shard = [None] * n
    for k in range(n):  # First to their own shards, then what finds them full goes on clockwise.
        s = ring[home[k]][1]
        if room[s]:
            shard[k], room[s] = s, room[s] - 1
    for k in range(n):
        at = home[k]
        while shard[k] is None:
            s = ring[at % len(ring)][1]
            if room[s]:
                shard[k], room[s] = s, room[s] - 1
            at += 1
    slots, out = Counter(), []
    for s in shard:
        out.append((s, slots[s]))
        slots[s] += 1
    return out


@pytest.mark.parametrize("shards,vnodes,slack", [(8, 128, 0.0), (3, 4, 0.0), (5, 16, 0.25), (1, 1, 0.0)])
def test_shards_equal_a_ring_walked_by_hand(spark, shards, vnodes, slack):
    r = random.Random(6)
    rows = [(None if k % 17 == 0 else r.choice([k, 3]), r.choice([None, "", f"text {k}"])) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit("x"))
    found = sharding.assign(docs, shards, vnodes, slack).collect()
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"), (F.octet_length(text) + 1).alias("size"), F.crc32(text).alias("crc")).collect()
    own = sorted(own, key=lambda x: (x.h, x.doc_id is not None, x.doc_id or 0, x.size, x.crc))
    want = plain_ring([x.h for x in own], shards, vnodes, slack)
    assert Counter((x.id, x.size, x.text_crc32, x.shard, x.slot) for x in found) == Counter((x.doc_id, x.size, x.crc, *w) for x, w in zip(own, want))


@pytest.mark.parametrize("slack", [0.0, 0.1, 0.5])
def test_bounded_loads_move_little(slack):
    r = random.Random(5)
    counts = Counter(r.randrange(sharding.BINS) for _ in range(50_000))

    def owner(shards):
        return {(b, k): s for b, a, z, s in sharding.segments(counts, shards, slack=slack) for k in range(a, z)}

    before, after = owner(8), owner(9)
    assert before.keys() == after.keys() and len(before) == 50_000
    most = max(Counter(before.values()).values())
    assert most <= -(-50_000 * (1 + slack) // 8)
    assert sum(before[k] != after[k] for k in before) < (0.35 if slack < 0.2 else 0.2) * 50_000


# -- Pipeline.
def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before, now = docs.count(), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, k
    kept = {x.doc_id: x.text for x in now.collect()}
    assert 0 < len(kept) < before
    index = decontam.Index([x.text for x in table(spark, SF, "benchmark").collect()])
    assert not any(index.find(t) for t in kept.values())
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    assert not any(a > b and bin(prints[a] ^ prints[b]).count("1") <= 2 for a in prints for b in prints)
    final = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in final} == set(kept)
    assert all(len(x.ids) == 4 * x.n_tokens for x in final)


def test_pipeline_stages_on_odd_rows(spark):
    r = random.Random(21)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 10))) for _ in range(n))
    good = [prose(r.randint(80, 200)) for _ in range(12)]
    item = table(spark, SF, "benchmark").first().text
    near = good[0].split(" ")
    near[40] = "other"
    texts = [*good, good[0], " ".join(near), prose(60) + " " + item + " " + prose(60), None, "", " \n", "short", "x" * 20000, "word " * 5000]
    rows = [(None if k in (3, 4, 5) else 7 if k in (6, 8) else k, t, None if k == 9 else "en", None if k == 10 else "s", 1, "r", k, "h") for k, t in enumerate(texts)]
    rows += [rows[1], rows[1], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, k int, hash string")
    names, now = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == names
        kept.append(Counter(x.k for x in now.collect()))
        assert stage(spark, docs.limit(0), SF).count() == 0
    clean = set(range(12))
    assert set(kept[0]) == clean | {12, 13, 14} and kept[0][1] == 3
    assert set(kept[1]) == clean | {14} and set(kept[2]) == clean | {14}
    assert kept[2][1] == 1 and kept[2][3] == 1 and kept[3] == Counter({k: 1 for k in clean})
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == 12 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert last.where("ids_sha256 is null or n_tokens = 0").count() == 0


def test_pipeline_leaves_its_last_rows_only(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 50
    assert [len(list(p.iterdir())) for p in Path(folder).glob("pipeline-*")][-1] == 1


def test_fingerprint_query_matches_brute_force(spark):
    texts = {x.doc_id: x.text for x in table(spark, SF, "documents").collect()}
    got = {x.doc_id: x for x in queries.op1_simhash(spark, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(prints, [(a, b) for a in prints for b in prints if a > b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    assert all(got[i].fingerprint == f"{p:016x}" and got[i].component_id == want[i] for i, p in prints.items())
