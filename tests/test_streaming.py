import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from recall_spark import schema
from recall_spark.operators import learning
from recall_spark.streaming import stateful
from recall_spark.streaming.daemons import Daemons
from recall_spark.sources.store import GraphStore

T0 = dt.datetime(2024, 1, 1)


def write_fires(spark, path, parts):
    for part in parts:
        rows = [("x", n, T0 + dt.timedelta(seconds=s), q) for n, s, q in part]
        spark.createDataFrame(rows, schema.FIRES_DDL).coalesce(1).write.mode("append").parquet(path)


def collected(spark, stream, tmp_path, mode="update"):
    out = str(tmp_path / "out")
    stateful.run_available(stream, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), str(tmp_path / "ck"), mode)
    return spark.read.parquet(out)


def test_learning_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "fires")
    events = [(f"n{(i * 7) % 5}", i * 2, i) for i in range(40)]
    write_fires(spark, path, [events[:15], events[15:30], events[30:]])
    got = collected(spark, stateful.learned(stateful.fires_stream(spark, path, 1)), tmp_path)
    last = {r.synapse_id: (r.co_fire_count, round(r.weight, 9)) for r in got.groupBy("synapse_id").agg(F.max("co_fire_count").alias("co_fire_count"), F.max("weight").alias("weight")).collect()}
    batch = {r.synapse_id: (r.co_fire_count, round(r.weight, 9)) for r in learning.learn(spark.read.parquet(path)).collect()}
    assert last == batch and batch


def test_co_fires_count_once_without_gathering(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice("xy"), f"n{r.randrange(6)}", T0 + dt.timedelta(seconds=r.randrange(90)), r.randrange(40)) for _ in range(260)]
    rows += rows[:20] + [("x", "n1", T0, None), ("x", "n1", T0, None), ("x", "n2", T0, 3), ("x", None, T0, 4), (None, "n1", T0, 5), ("x", "n1", None, 6), ("x", "n3", T0 + dt.timedelta(seconds=5), None)]
    met = {}
    for i, a, t, s in rows:
        for j, b, u, q in rows:
            if None not in (i, j, a, b, t, u) and i == j and a != b and 0 <= (t - u).total_seconds() <= 5 and (u < t or None not in (q, s) and q < s):
                met[i, a, b, t, s] = max(u, met.get((i, a, b, t, s), u))
    found = learning.co_fires(spark.createDataFrame(rows, schema.FIRES_DDL))
    got = found.select("index_id", "a", "b", "ts", "seq", F.timestamp_micros("last").cast("timestamp_ntz").alias("last")).collect()
    assert len(got) == len(met) > 500 and {tuple(x)[:5]: x.last for x in got} == met
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = Counter((i, min(a, b), max(a, b)) for i, a, b, _, _ in met)
    for cell in (learning.CELL, 100):
        monkeypatch.setattr(learning, "CELL", cell)
        counted = learning.pair_counts(spark.createDataFrame(rows, schema.FIRES_DDL))
        assert {tuple(x)[:3]: x.co_fire_count for x in counted.collect()} == pairs and counted.count() == len(pairs)
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "cell" in plan and "Exchange" not in plan.split("Join")[0]


def test_degree_cap(spark, tmp_path):
    path = str(tmp_path / "fires")
    write_fires(spark, path, [[(f"n{i}", 0, i) for i in range(6)]])
    got = collected(spark, stateful.learned(stateful.fires_stream(spark, path), most=2), tmp_path).collect()
    degree = {}
    for r in got:
        for n in (r.from_id, r.to_id):
            degree[n] = degree.get(n, 0) + 1
    assert got and max(degree.values()) <= 2


def test_lifecycle_stream(spark, tmp_path):
    path = str(tmp_path / "fires")
    write_fires(spark, path, [[("a", 0, 0), ("a", 10, 1)], [("a", 1000, 2)]])
    got = collected(spark, stateful.lifecycle(stateful.fires_stream(spark, path, 1)), tmp_path).orderBy("batch").collect()
    us = lambda s: int((T0 + dt.timedelta(seconds=s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert sorted((r.last_us, r.invoke_count, r.session_us) for r in got)[-1] == (us(1000), 3, us(1000))


def test_sessions_and_windows(spark, tmp_path):
    path = str(tmp_path / "fires")
    write_fires(spark, path, [[("a", 0, 0), ("a", 60, 1), ("a", 4000, 2)]])
    got = collected(spark, stateful.sessions(stateful.fires_stream(spark, path)), tmp_path, "append").collect()
    assert [r.ops for r in got] == [2]  # the watermark closes the first session only
    batch = stateful.activity_counts(spark.read.parquet(path)).collect()
    assert sum(r.ops for r in batch) == 15


def test_coalesced(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in stateful.coalesced(rows, ["k"]).collect()} == {("a", "new"), ("b", "only")}


def test_daemons(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "s"))
    names = [c.split()[0] for c in schema.NEURONS_DDL.split(", ")]
    base = dict(content="x", content_hash="h", position=[0.1, 0.1, 0.1], energy=0.4, base_energy=0.1, depth=0, created_at=T0, last_fired_at=T0, last_decay_at=T0, access_count=20, tags=[], sentiment_label="", sentiment_score=0.0, embedding=None, metadata={})
    rows = [tuple((base | {"index_id": i, "neuron_id": i + "1", "content": i})[n] for n in names) for i in ("awake", "sleepy")]
    store.commit({"neurons": spark.createDataFrame(rows, schema.NEURONS_DDL)})
    now = T0 + dt.timedelta(hours=1)
    activity = spark.createDataFrame([("awake", now), ("sleepy", now - dt.timedelta(minutes=10))], schema.ACTIVITY_DDL)
    at = F.lit(str(now)).cast("timestamp_ntz")
    d = Daemons(store, activity)
    d.decay(at)
    d.consolidate(at)
    d.reorganise(at)
    d.prune()
    got = {r.index_id: r for r in store.read("neurons").collect()}
    assert round(got["awake"].energy, 6) == 0.3 and got["sleepy"].energy == 0.4
    assert got["awake"].depth == 0 and got["sleepy"].depth == 1
