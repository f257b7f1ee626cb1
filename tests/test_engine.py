import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recall_spark import errors, schema
from recall_spark.config import EngineConfig, clamp, parse_connection, seconds
from recall_spark.engine import MemoryEngine
from recall_spark.operators import commands, context, dynamics, filters, ingest, lifecycle, observe, scoring, spatial, spread
from recall_spark.sources.registry import Registry
from recall_spark.sources.store import GraphStore

NOW = dt.datetime(2024, 2, 1)
AT = None
NAMES = [c.split()[0] for c in schema.NEURONS_DDL.split(", ")]


@pytest.fixture(scope="module", autouse=True)
def at(spark):
    global AT
    AT = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def neuron(i, content, index="t", **kw):
    base = dict(index_id=index, neuron_id=i, content=content, content_hash=i, position=[0.0, 0.0, 0.0], energy=1.0, base_energy=0.1, depth=0, created_at=NOW, last_fired_at=NOW, last_decay_at=NOW, access_count=1, tags=[], sentiment_label="", sentiment_score=0.0, embedding=None, metadata={})
    return tuple((base | kw)[n] for n in NAMES)


def neurons(spark, *rows):
    return spark.createDataFrame(list(rows), schema.NEURONS_DDL)


def synapses(spark, *rows):
    return spark.createDataFrame([("t", f"{a}:{b}", a, b, w, 1, NOW, NOW) for a, b, w in rows], schema.SYNAPSES_DDL)


def ids(df):
    return [r.neuron_id for r in df.collect()]


def rank(spark, query, *rows, **kw):
    return ids(scoring.top(scoring.scored(neurons(spark, *rows), query, AT, **kw), 20))


def test_search_counts_and_ranks(spark):
    three = [neuron("1", "TypeScript programming language"), neuron("2", "Go programming"), neuron("3", "Cooking recipes")]
    assert set(rank(spark, "programming", *three)) == {"1", "2"}
    assert rank(spark, "Python", *three) == []
    assert rank(spark, "!", *three) == []
    assert rank(spark, "typescript programming", *three)[0] == "1"
    assert rank(spark, "docker containers", neuron("a", "containers for docker"), neuron("b", "docker containers"))[0] == "b"
    assert rank(spark, "same", neuron("a", "same words", energy=0.2), neuron("b", "same words", energy=1.0)) == ["b", "a"]
    assert rank(spark, "same", neuron("a", "same words", depth=5), neuron("b", "same words")) == ["b", "a"]
    assert rank(spark, "same", neuron("a", "same words", last_fired_at=NOW - dt.timedelta(days=30)), neuron("b", "same words")) == ["b", "a"]
    both = [neuron("a", "same words"), neuron("b", "same words", metadata={"thread_id": "9"})]
    assert rank(spark, "same", *both, metadata={"thread_id": "9"}) == ["b", "a"]
    assert rank(spark, "same", *both, metadata={"thread_id": "9"}, strict=True) == ["b"]


def test_lexical_score_by_hand(spark):
    rows = neurons(spark, neuron("a", "Programming in Go"))
    score = lambda q: rows.select(scoring.lexical(F.col("content"), F.array(F.lit("programming"), F.lit("in"), F.lit("go")), F.lit(q), F.array(*[F.lit(w) for w in q.lower().split()])).alias("s")).first().s
    assert score("programming") == pytest.approx(15.0)  # phrase and full overlap
    assert score("programmer go zzz words") == pytest.approx(0.3 + 5.0 * 2 / 4)
    assert score("programmin") == pytest.approx(10 + 0.3 + 5)
    assert score("programmixg") == pytest.approx(0.3 + 5 + 2 * (1 - 1 / 11))


def test_hybrid_branch(spark):
    rows = [neuron("a", "none", embedding=[1.0, 0.0]), neuron("b", "none", embedding=[0.0, 1.0]), neuron("c", "word here"), neuron("d", "none", embedding=[1.0])]
    assert rank(spark, "word", *rows, query_vector=[1.0, 0.0]) == ["c", "a"]


@pytest.mark.parametrize(
    "spec,hit",
    [
        ({}, True),
        ({"energy": 0.5}, True), ({"depth": 1}, True), ({"depth": 2}, False),
        ({"energy": {"$gt": 0.4}}, True), ({"energy": {"$gt": 0.5}}, False), ({"energy": {"$gte": 0.5}}, True), ({"energy": {"$lt": 0.5}}, False), ({"energy": {"$lte": 0.5}}, True),
        ({"content": {"$gt": 1}}, False), ({"energy": {"$gt": "a"}}, False),
        ({"depth": {"$ne": 2}}, True), ({"missing": {"$ne": 2}}, True), ({"missing": None}, True), ({"missing": {"$nin": ["a"]}}, True), ({"missing": {"$in": ["a"]}}, False),
        ({"depth": {"$in": [0, 1]}}, True), ({"depth": {"$in": 1}}, False), ({"depth": {"$nin": 1}}, True),
        ({"content": {"$regex": "^Hel+o"}}, True), ({"content": {"$regex": "hello"}}, False), ({"content": {"$regex": "("}}, False),
        ({"content": {"$contains": "WORLD"}}, True), ({"energy": {"$contains": "x"}}, True),
        ({"role": {"$exists": True}}, True), ({"missing": {"$exists": True}}, False), ({"missing": {"$exists": False}}, True),
        ({"role": "user"}, True), ({"role": {"$eq": "bot"}}, False),
        ({"$and": [{"depth": 1}, {"role": "user"}]}, True), ({"$or": [{"depth": 9}, {"role": "user"}]}, True), ({"$or": []}, False), ({"$and": []}, True),
        ({"$not": {"depth": 1}}, False), ({"$not": {"missing": {"$gt": 1}}}, True), ({"$not": {"missing": "a"}}, True),
        ({"$what": 1}, False), ({"$and": {"depth": 1}}, False), ({"depth": {"$what": 1}}, True),
        ({"createdAt": {"$lte": "2024-02-01 00:00:00"}}, True), ({"createdAt": {"$gt": "2024-02-01 00:00:00"}}, False),
    ],
)
def test_filters(spark, spec, hit):
    rows = neurons(spark, neuron("n", "Hello World", energy=0.5, depth=1, metadata={"role": "user"}))
    assert (rows.where(filters.compile_filter(spec)).count() == 1) is hit
    assert (rows.where(filters.compile_filter({"$not": spec})).count() == 0) is hit


def test_strict_filters(spark):
    rows = neurons(spark, neuron("n", "x", depth=1))
    check = lambda spec: rows.where(filters.compile_filter(spec, strict=True)).count() == 1
    assert check({"depth": 1}) is False and check({"depth": {"$gte": 1}}) is True and check({"createdAt": {"$gt": "2020-01-01"}}) is False
    with pytest.raises(ValueError):
        filters.compile_filter({"a": {"$exists": 1}})
    with pytest.raises(ValueError):
        filters.compile_filter({"a": {"$contains": 1}})


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    neurons(spark, neuron("a", "x")).write.parquet(path)
    plan = spark.read.parquet(path).where(filters.compile_filter({"energy": {"$gt": 0.5}})).select("neuron_id")._jdf.queryExecution().toString()
    assert "GreaterThan(energy,0.5)" in plan and "content" not in plan.split("ReadSchema")[-1]


def test_commands(spark):
    e = MemoryEngine(neurons(spark, *[neuron(str(i), f"text number {i}", energy=i / 10) for i in range(1, 10)]), synapses(spark, ("1", "2", 0.5)), AT).index("t")
    docs = e.execute({"type": "find", "filter": {"energy": {"$gt": 0.3}}, "options": {"limit": 3, "skip": 1, "projection": {"_id": 1}}}).collect()
    assert [r._id for r in docs] == ["8", "7", "6"]
    assert e.execute('{"type": "findOne", "filter": {}}').first()._id == "9"
    assert e.execute({"type": "count", "filter": {"energy": {"$lte": 0.3}}}).first()["count"] == 3
    assert e.execute({"type": "find", "collection": "synapses"}).first().weight == 0.5
    assert e.execute({"type": "find", "collection": "nothing"}).count() == 0
    assert e.execute({"type": "stats"}).first().neuron_count == 9
    assert e.execute({"type": "search", "filter": {"query": "number"}, "options": {"limit": 4, "depth": 0}}).count() == 4
    assert set(e.execute({"type": "find", "options": {"projection": {"content": 0}}}).columns) == set(commands.DOCUMENT) - {"content"}
    for kind in commands.BLOCKED:
        with pytest.raises(errors.MutationDisabled):
            e.execute({"type": kind})
    with pytest.raises(errors.EngineError, match="unknown command type: aggregate"):
        e.execute({"type": "aggregate"})
    with pytest.raises(errors.InvalidJSON):
        e.execute("{")
    e.commands.register("ping", lambda engine, cmd: "pong")
    assert "ping" in e.commands.list() and e.execute({"type": "ping"}) == "pong"
    e.commands.unregister("ping")
    with pytest.raises(errors.EngineError):
        e.execute({"type": "ping"})


def walk(edges, seeds, depth):
    """Spread activation as a loop, for comparison."""
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w, f"{a}:{b}"))
        adj.setdefault(b, []).append((a, w, f"{a}:{b}"))
    found, now = dict(seeds), sorted(seeds, key=lambda x: (-x[1], x[0]))
    for hop in range(depth):
        nxt = []
        for a, s in now:
            for b, w, _ in sorted(adj.get(a, []), key=lambda x: x[2]):
                v = s * w * (1.0 / (hop + 2))
                if b not in found and v > 0.1:
                    found[b] = v
                    nxt.append((b, v))
        now = nxt
    return found


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_spread_matches_a_loop(spark, depth):
    edges = [(str(i), str((i * 7 + k) % 40), ((i * 13 + k * 5) % 10) / 10) for i in range(40) for k in (1, 3) if str(i) != str((i * 7 + k) % 40)]
    edges = list({(min(a, b), max(a, b)): (a, b, w) for a, b, w in edges}.values())
    seeds = [("0", 3.0), ("5", 2.0), ("9", 2.0)]
    own = neurons(spark, *[neuron(str(i), "x") for i in range(40)])
    start = spark.createDataFrame([("t", *s) for s in seeds], "index_id string, neuron_id string, score double")
    got = {r.neuron_id: r.score for r in spread.spread(start, synapses(spark, *edges), own, depth).collect()}
    want = walk(edges, seeds, depth)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_search_spreads_and_clamps(spark):
    e = MemoryEngine(neurons(spark, neuron("1", "needle"), neuron("2", "other")), synapses(spark, ("1", "2", 0.8)), AT)
    assert ids(e.search("needle", depth=1).result) == ["1", "2"]
    assert ids(e.search("needle", depth=0).result) == ["1"]
    many = MemoryEngine(neurons(spark, *[neuron(str(i), "word") for i in range(220)]), synapses(spark), AT)
    assert many.search("word", depth=0, limit=9999).result.count() == 200
    assert clamp(999, 2, 8) == 8 and clamp(0, 2, 8) == 2 and clamp(None, 20, 200) == 20
    with pytest.raises(errors.QueryRequired):
        e.search("  ")
    fired = e.apply(e.search("needle", depth=0).fires).neurons.where("neuron_id = '1'").first()
    assert (fired.energy, fired.access_count) == (1.0, 2)


def test_write(spark):
    e = MemoryEngine.empty(spark, as_of=AT, config=EngineConfig(max_neurons=3)).index("t")
    one = e.write([{"content": "hello world"}, {"content": "hello world"}, {"content": " "}, {"content": "x" * 70000}, {"content": "hello you", "metadata": {"k": "v"}, "tags": ["a"]}])
    got = {r.content: r for r in one.neurons.collect()}
    assert set(got) == {"hello world", "hello you"}
    assert got["hello world"].access_count == 2 and got["hello world"].energy == 1.0
    assert got["hello you"].metadata == {"k": "v"} and got["hello you"].tags == ["a"] and len(got["hello you"].position) == 3
    assert sorted((r.seq, r.reason) for r in one.written.rejected.collect()) == [(2, "INVALID_CONTENT"), (3, "PAYLOAD_TOO_LARGE")]
    two = one.write([{"content": "hello world"}, {"content": "new thing"}, {"content": "one too many"}])
    assert two.neurons.count() == 3 and [r.reason for r in two.written.rejected.collect()] == ["CONFLICT"]
    assert {r.content: r.access_count for r in two.neurons.collect()}["hello world"] == 3
    near = {r.content: r.position for r in one.write([{"content": "hello there world"}]).neurons.collect()}
    assert all(abs(a - b) <= 0.2 + 1e-9 for a, b in zip(near["hello there world"], near["hello world"]))
    with pytest.raises(errors.IndexIDRequired):
        MemoryEngine.empty(spark).write([{"content": "x"}])
    gone = two.forget(got["hello you"].neuron_id)
    assert gone.neurons.count() == 2 and two.drop_index("t").neurons.count() == 0


def test_dynamics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [round(one(dynamics.fire(F.lit(x))), 9) for x in (0.5, 0.9)] == [0.8, 1.0]
    assert [round(one(dynamics.strengthen(F.lit(a), b)), 9) for a, b in ((0.3, 0.2), (0.9, 0.5))] == [0.5, 1.0]
    assert [round(one(dynamics.weaken(F.lit(a), b)), 9) for a, b in ((0.5, 0.2), (0.1, 0.5))] == [0.3, 0.0]
    cases = [(5, 10, 1.0), (15, 10, 1.0), (15, 60, 1.0), (15, 60, 0.3)]
    rows = neurons(spark, *[neuron(str(i), "x", access_count=a, created_at=NOW - dt.timedelta(minutes=m), energy=e) for i, (a, m, e) in enumerate(cases)])
    assert [r.depth for r in dynamics.consolidate(rows, AT).orderBy("neuron_id").collect()] == [0, 0, 0, 1]
    old = neurons(spark, neuron("a", "x", energy=0.9, last_decay_at=NOW - dt.timedelta(hours=2)), neuron("b", "x", energy=0.9, last_decay_at=NOW - dt.timedelta(days=9)))
    assert [round(r.energy, 9) for r in dynamics.decay_nodes(old, AT).orderBy("neuron_id").collect()] == [0.7, 0.1]
    w = 0.2
    for tick in range(1, 43):
        w = max(0, w - 0.01 * 60 * tick / 3600)
    assert one(dynamics.decayed_weight(F.lit(0.2), 42, 60.0)) == pytest.approx(w) and w <= 0.051
    n, s = dynamics.prune(neurons(spark, neuron("a", "x", energy=0.005), neuron("b", "x"), neuron("c", "x")), synapses(spark, ("a", "b", 0.9), ("b", "c", 0.9), ("c", "b", 0.01)))
    assert ids(n) == ["b", "c"] and [r.synapse_id for r in s.collect()] == ["b:c"]
    again = dynamics.prune(n, s)
    assert again[0].count() == 2 and again[1].count() == 1
    changed = dynamics.update(neurons(spark, neuron("a", "x", metadata={"k": "1", "l": "2"})), F.lit(True), {"$set": {"content": "y", "metadata": {"k": "3"}}, "$inc": {"energy": -5}, "$push": {"tags": "t"}}).first()
    assert (changed.content, changed.metadata, changed.energy, changed.tags) == ("y", {"k": "3", "l": "2"}, 0.0, ["t"])


def test_context_never_exceeds(spark):
    rows = neurons(spark, *[neuron(str(i), "x" * (4 * i), depth=i % 2, energy=1 - i / 100) for i in range(1, 8)])
    ranked = rows.withColumn("rank", F.col("neuron_id").cast("int"))
    kept = context.within_budget(ranked, 10, ["index_id"]).collect()
    assert sorted(r.tokens for r in kept) == [1, 2, 3, 4]
    text = context.assembled(ranked, 3, ["index_id"]).first()
    assert text.context == "xxxx [depth:1]\n---\nxxxxxxxx" and text.estimated_tokens == 3


def test_lifecycle_and_limits(spark):
    one = lambda s: spark.range(1).select(lifecycle.state(F.lit(s)).alias("x")).first().x
    assert [one(s) for s in (0, 30, 31, 300, 301, 1800, 1801, None)] == ["active", "active", "idle", "idle", "sleeping", "sleeping", "dormant", "dormant"]
    act = spark.createDataFrame([("a", NOW - dt.timedelta(seconds=s)) for s in (1, 2, 3, 400, 401)], "index_id string, ts timestamp_ntz")
    assert lifecycle.sessions(act).count() == 2
    assert [r.sparse for r in lifecycle.sparseness(act).orderBy("ts").collect()] == [True, True, True, True, False]
    dist = lifecycle.distribution(lifecycle.states(act, AT)).first()
    assert (dist.total, dist.active, dist.dormant) == (1, 1, 0)
    asked = spark.createDataFrame([("c", i, NOW + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 61, 62))], "client string, request_id int, ts timestamp_ntz")
    assert [(r.request_id, r.n) for r in lifecycle.rate_limited(asked, 2).collect()] == [(2, 3)]


def plain_limited(rows, limit, window):
    """A window starts anew at the first request after it ran out."""
    out, state = [], {}
    for who, i, s in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        start, n = state.get(who, (None, 0))
        start, n = (s, 1) if start is None or s - start >= window else (start, n + 1)
        state[who] = start, n
        out += [(who, i)] if n > limit else []
    return sorted(out)


def test_rate_limit_windows_follow_requests(spark):
    r = random.Random(3)
    rows = [(f"c{r.randint(0, 3)}", i, r.randint(0, 3000)) for i in range(900)]
    df = spark.createDataFrame([(c, i, NOW + dt.timedelta(seconds=s)) for c, i, s in rows], "client string, request_id int, ts timestamp_ntz")
    for limit, window in ((1, 60), (3, 100)):
        assert sorted((x.client, x.request_id) for x in lifecycle.rate_limited(df.repartition(7), limit, window).collect()) == plain_limited(rows, limit, window)


def test_regex_is_re2s(spark):
    df = neurons(spark, *[neuron(str(i), c) for i, c in enumerate(["abc", "ab\n", "É x\x0by", "12", "a[b&c"])])
    found = lambda p: ids(df.where(filters.compile_filter({"content": {"$regex": p}})).orderBy("neuron_id"))
    assert found(r"\p{L}+") == ["0", "1", "2", "4"] and found("(?P<name>b)c") == ["0"]
    assert found("b$") == [] and found("(?m)b$") == ["1"] and found("(?i)é") == ["2"]
    assert found(r"\s") == ["1", "2"] and found(r"x\sy") == [] and found(r"x\vy") == ["2"]
    assert found("[[:digit:]]") == ["3"] and found("[[&]") == ["4"] and found(r"^\Qa[b\E") == ["4"]
    for refused in (r"a(?=b)", r"(a)\1", "a*+", "a++", "(", r"\Z", "(?<n>a)(?>b)"):
        assert found(refused) == []


def test_spatial(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(spatial.dimension(F.lit(n))) for n in (1, 300, 301, 10**7)] == [3, 3, 4, 1000]
    assert one(spatial.attract(F.array(F.lit(0.0)), F.array(F.lit(1.0)), 0.5)) == [0.25]
    p = one(spatial.random_position(F.lit("k"), 5))
    assert len(p) == 5 and all(-1 <= x < 1 for x in p) and p == one(spatial.random_position(F.lit("k"), 5))
    assert one(spatial.resized(F.array(F.lit(0.5)), F.lit(3), F.lit("k")))[0] == 0.5
    rows = neurons(spark, neuron("a", "x", position=[0.0]), neuron("b", "x", position=[1.0]), neuron("c", "x", position=[-0.5]))
    edges = synapses(spark, ("a", "b", 0.8))
    moved = {r.neuron_id: r.position[0] for r in spatial.reorganise(rows, edges).collect()}
    assert 0 < moved["a"] < moved["b"] < 1 and moved["c"] == -0.5
    pushed = {r.neuron_id: r.position[0] for r in spatial.repelled(rows, edges, 0.3).collect()}
    assert pushed["c"] <= -0.5


def test_store_and_registry(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "store"))
    assert store.indexes().count() == 0
    n = neurons(spark, neuron("a", "x"), neuron("b", "y", index="u"), neuron("c", "x", created_at=NOW + dt.timedelta(1)))
    store.commit({"neurons": n, "synapses": synapses(spark, ("a", "zz", 0.5), ("a", "c", 1.5))})
    assert store.exists("t") and not store.exists("nope") and store.load("u")[0].count() == 1
    store.save("neurons", neurons(spark, neuron("b2", "new", index="u")))
    assert ids(store.load("u")[0]) == ["b2"] and store.load("t")[0].count() == 2
    report = store.repair().first()
    assert (report.dangling_synapses, report.repeated_contents, report.bad_weight) == (1, 1, 1)
    assert ids(store.load("t")[0]) == ["a"] and store.read("synapses").count() == 0
    store.delete("u")
    assert not store.exists("u") and store.vacuum() > 0 and store.exists("t")
    assert observe.integrity(store.read("neurons"), store.read("synapses")).first().dangling_synapses == 0


def test_batch_scores_equal_single_searches(spark):
    r = random.Random(5)
    bits = ["green", "greener", "gr", "tea", "teapot", "unable", "able", "é", "éclair", "日本", "pot", "x", "GREEN", "te", "able-bodied"]
    say = lambda n: r.choice([" ", ", ", " - "]).join(r.choice(bits) for _ in range(n))
    rows = [neuron(f"n{k:03d}", say(r.randint(0, 12)), index=r.choice("ab"), energy=r.random(), depth=k % 3, access_count=k) for k in range(120)]
    asked = [(k, r.choice(["a", "b", None]), q) for k, q in enumerate([say(r.randint(1, 6)) for _ in range(25)] + ["", ". ,", "gren", "teapt", "éclar", "able", "green, tea"])]
    nodes = neurons(spark, *rows)
    got = scoring.batch(nodes, spark.createDataFrame(asked, "query_id int, index_id string, query string"), AT, 500, block=7).collect()
    have = {}
    for x in got:
        have.setdefault(x.query_id, []).append((x.rank, x.neuron_id, round(x.score, 9)))
    for k, index, q in asked:
        where = nodes if index is None else nodes.where(F.col("index_id") == index)
        want = scoring.scored(where, q, AT).orderBy(F.desc("score"), "neuron_id").collect()
        assert sorted(have.get(k, [])) == [(n, x.neuron_id, round(x.score, 9)) for n, x in enumerate(want, 1)], q
    few = scoring.batch(nodes, spark.createDataFrame(asked, "query_id int, index_id string, query string"), AT, 3).collect()
    assert {(x.query_id, x.rank, x.neuron_id) for x in few} == {(k, n, i) for k, v in have.items() for n, i, _ in v if n <= 3}


def test_nearest_by_words_equals_brute_force(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["the", "The", "a", "cat", "dog", "é", "mat", "sat"]) for _ in range(n))
    new = [(r.choice("ab"), f"h{k}", say(r.randint(0, 6))) for k in range(40)]
    old = [(r.choice("ab"), f"n{k}", say(r.randint(0, 6))) for k in range(60)]
    df = lambda rows, c: spark.createDataFrame(rows, f"index_id string, {c} string, content string")
    got = {(x.index_id, x.content_hash): (x.nearest_id, x.overlap) for x in ingest.nearest_by_words(df(new, "content_hash"), df(old, "neuron_id"), 4).collect()}
    for i, h, c in new:
        own = c.lower().split()
        every = [(sum(w in set(o.lower().split()) for w in own) / max(len(own), len(o.split()), 1), n) for j, n, o in old if i == j]
        best = max(every)
        assert got.get((i, h)) == ((best[1], best[0]) if best[0] > 0 else None)


def test_store_writes_touched_indexes_only(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "s"))
    store.commit({"neurons": neurons(spark, *[neuron(f"n{k}", "text", index=f"i{k}") for k in range(6)])})
    before = set((tmp_path / "s" / "neurons").rglob("*.parquet"))
    store.save("neurons", neurons(spark, neuron("new", "text", index="i3")))
    fresh = set((tmp_path / "s" / "neurons").rglob("*.parquet")) - before
    assert {p.parent.name for p in fresh} == {"index_id=i3"}
    assert sorted(ids(store.read("neurons"))) == ["n0", "n1", "n2", "n4", "n5", "new"]
    store.delete("i0")
    assert set((tmp_path / "s" / "neurons").rglob("*.parquet")) == before | fresh and not store.exists("i0")
    store.MOST_PARTS = 2
    store.save("neurons", neurons(spark, neuron("back", "text", index="i0")))
    assert len(store.latest()[1]["neurons"]) == 1 and sorted(ids(store.read("neurons"))) == ["back", "n1", "n2", "n4", "n5", "new"]


def test_store_survives_a_killed_writer_and_tells_of_clashes(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "s"))
    store.save("neurons", neurons(spark, neuron("a", "text")))
    last = store.latest()
    # Killed after the data, before the commit; then in the middle of the commit file.
    store._written("neurons", neurons(spark, neuron("b", "text")))
    assert ids(GraphStore.open(spark, store.path).read("neurons")) == ["a"]
    (tmp_path / "s" / "_commits" / f"{last[0] + 1:012d}.json").write_text('{"neurons": [{"v"')
    again = GraphStore.open(spark, store.path)
    assert again.latest() == last
    again.save("neurons", neurons(spark, neuron("c", "text")))
    assert ids(store.read("neurons")) == ["c"]
    with pytest.raises(errors.Conflict):
        store._next(last, {})
    for f in (tmp_path / "s" / "_commits").iterdir():
        f.unlink()
    with pytest.raises(errors.InternalError):
        GraphStore.open(spark, store.path)
    assert any((tmp_path / "s" / "neurons").rglob("*.parquet"))
    reg = Registry.empty(spark).create("i1", {"k": "v"}, "2024-01-01")
    with pytest.raises(errors.UUIDConflict):
        reg.create("i1", None, "2024-01-01")
    reg, made = reg.find_or_create("i2", None, "2024-01-02")
    assert made and reg.find_or_create("i2", None, "2024-01-02")[1] is False
    reg = reg.update("i2", "2024-01-03", {"a": "b"}, rename="i3")
    assert [r.uuid for r in reg.list().collect()] == ["i1", "i3"] and reg.get("i3").first().metadata == {"a": "b"}
    with pytest.raises(errors.UUIDNotFound):
        reg.delete("i2")
    reg.delete("i1").save(str(tmp_path / "reg"))
    assert Registry.load(spark, str(tmp_path / "reg")).count() == 1
    assert reg.upserted(spark.createDataFrame([("i1", {"z": "1"}, NOW, NOW), ("i9", None, NOW, NOW)], schema.REGISTRY_DDL)).count() == 3


def test_many_indexes(spark):
    rows = neurons(spark, neuron("1", "user one", index="a", energy=0.9), neuron("2", "user two", index="b"), neuron("3", "user three", index="c", energy=0.5), neuron("4", "else", index="c"))
    e = MemoryEngine(rows, synapses(spark), AT)
    assert ids(e.global_search("user")) == ["2", "1", "3"]
    assert ids(e.multi_search(["a", "c", "none"], "user")) == ["1", "3"]
    assert [r.index_id for r in e.recent_indexes(min_neurons=2).collect()] == ["c"]
    assert e.list_indexes().count() == 3
    with pytest.raises(errors.IndexIDRequired):
        e.multi_search([], "x")


def test_config(tmp_path):
    assert seconds("1h30m") == 5400 and seconds("250ms") == 0.25 and seconds(3) == 3
    with pytest.raises(ValueError):
        seconds("soon")
    path = tmp_path / "c.json"
    path.write_text('{"alpha": 0.1, "idle_threshold": "10s", "max_neurons": 5}')
    c = EngineConfig.load(str(path), {"RECALL_ALPHA": "0.2", "RECALL_REGISTRY_ENABLED": "true"}, {"max_neurons": 9, "query_repeat": None})
    assert (c.alpha, c.idle_threshold, c.max_neurons, c.registry_enabled) == (0.2, 10.0, 9, True)
    with pytest.raises(ValueError, match="alpha.*|thresholds.*"):
        EngineConfig(alpha=2.0, idle_threshold=900.0).validate()
    new, changed, rejected = EngineConfig().patch({"lifecycle": {"idleThreshold": "45s", "sleepThreshold": "soon"}, "vector": {"alpha": 3}, "matrix": {"maxNeurons": 0}, "x": {"y": 1}})
    assert changed == ["lifecycle.idleThreshold"] and new.idle_threshold == 45 and len(rejected) == 4
    got = parse_connection("recall+tls://u:p@h1,h2:99/idx")
    assert got == {"tls": True, "user": "u", "password": "p", "hosts": ["h1:6060", "h2:99"], "index_id": "idx"}
    for bad in ("", "http://h", "recall://"):
        with pytest.raises(ValueError):
            parse_connection(bad)
