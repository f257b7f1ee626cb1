"""The Parquet store: tables partitioned by index, in parts that numbered commits list."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark import schema
from recall_spark.errors import Conflict, InternalError


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="recall-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


TABLES = {"neurons": schema.NEURONS_DDL, "synapses": schema.SYNAPSES_DDL}


class GraphStore:
    """Graph tables under one folder, on any file system Spark can reach.

    A table is a list of parts, ``<path>/<table>/v=<version>`` partitioned by ``index_id``; a part may be
    without some of its indexes, which a later part holds or which are deleted. Commit n is the file
    ``<path>/_commits/<n>.json``, which lists all parts; it is created, never replaced, and written after
    the data, so a reader of the highest whole commit sees all of a write or none. Of two writers that
    began at the same commit the second one to create the next has a ``Conflict`` and has changed nothing.
    """

    #: Parts of a table, or indexes that its parts are without, beyond which a save rewrites the table.
    MOST_PARTS, MOST_GONE = 32, 10_000

    def __init__(self, spark: SparkSession, path: str, compress: bool = True) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.codec = "zstd" if compress else "none"

    @classmethod
    def open(cls, spark: SparkSession, path: str, compress: bool = True) -> GraphStore:
        """A store with its tables there; an empty one is created where the folder holds no data."""
        store = cls(spark, path, compress)
        if store.latest() is None:
            if any(store._names(t) for t in TABLES):
                raise InternalError(f"{store.path} holds data but no whole commit")
            store.commit({t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()})
        return store

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commit_file(self, n: int) -> str:
        return f"{self.path}/_commits/{n:012d}.json"

    def latest(self) -> tuple[int, dict[str, list[dict]]] | None:
        """Number and parts of the last whole commit. A file that a writer left half written is none."""
        for name in reversed(self._names("_commits")):
            fs, p = self._fs(f"{self.path}/_commits/{name}")
            stream = fs.open(p)
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
            stream.close()
            try:
                return int(name.split(".")[0]), json.loads(text)
            except ValueError:
                continue
        return None

    def _next(self, last: tuple[int, dict] | None, tables: dict[str, list[dict]]) -> None:
        """Create the commit after ``last``; a half written file of that number counts as taken by nobody."""
        n = (last[0] if last else 0) + 1
        taken = [int(x.split(".")[0]) for x in self._names("_commits")]
        now = self.latest()
        if (now[0] if now else 0) != n - 1:
            raise Conflict(f"{self.path} has commit {now[0]}, the write began at {n - 1}")
        n = max([n, *(x + 1 for x in taken)])
        fs, p = self._fs(self._commit_file(n))
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{self.path}: another write made commit {n}") from e
            raise
        out.write(bytearray(json.dumps(((last[1] if last else {}) | tables)).encode()))
        out.close()

    def _written(self, table: str, df: DataFrame) -> dict:
        version = uuid.uuid4().hex
        df.write.partitionBy("index_id").option("compression", self.codec).parquet(f"{self.path}/{table}/v={version}")
        return {"v": version, "without": []}

    def _read(self, table: str, parts: list[dict]) -> DataFrame:
        out = None
        for part in parts:
            df = self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/v={part['v']}")
            df = df.where(~F.col("index_id").isin(part["without"])) if part["without"] else df
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], TABLES[table]) if out is None else out

    def read(self, table: str) -> DataFrame:
        """A table at the last commit; filters on ``index_id`` prune partitions."""
        return self._read(table, self.latest()[1][table])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replace whole tables."""
        last = self.latest()
        self._next(last, {name: [self._written(name, df)] for name, df in tables.items()})

    def save(self, table: str, changed: DataFrame) -> None:
        """Replace the indexes that ``changed`` holds; only their rows are written.

        The touched indexes are listed on the driver. After ``MOST_PARTS`` saves, or ``MOST_GONE`` indexes
        replaced, the table is written as one part again.
        """
        last = self.latest()
        changed = durable(changed)
        touched = sorted(r.index_id for r in changed.select("index_id").distinct().collect())
        parts = self._without(last[1][table], touched)
        if len(parts) >= self.MOST_PARTS or sum(len(p["without"]) for p in parts) > self.MOST_GONE:
            kept = self._read(table, parts)
            self._next(last, {table: [self._written(table, kept.unionByName(changed.select(*kept.columns)))]})
        else:
            self._next(last, {table: [*parts, self._written(table, changed.select(*[f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]))]})

    @staticmethod
    def _without(parts: list[dict], indexes: list[str]) -> list[dict]:
        return [p | {"without": sorted({*p["without"], *indexes})} for p in parts]

    def indexes(self) -> DataFrame:
        return self.read("neurons").select("index_id").distinct()

    def load(self, index_id: str) -> tuple[DataFrame, DataFrame]:
        one = F.col("index_id") == index_id
        return self.read("neurons").where(one), self.read("synapses").where(one)

    def exists(self, index_id: str) -> bool:
        return not self.load(index_id)[0].limit(1).isEmpty()

    def delete(self, index_id: str) -> None:
        """Leave an index out; no data is written."""
        last = self.latest()
        self._next(last, {t: self._without(last[1][t], [index_id]) for t in TABLES})

    def vacuum(self) -> int:
        """Remove parts that the last commit doesn't list, and the commits before it; the number of parts."""
        n, tables = self.latest()
        gone = 0
        for table in TABLES:
            live = {f"v={p['v']}" for p in tables[table]}
            for name in self._names(table):
                if name not in live:
                    fs, p = self._fs(f"{self.path}/{table}/{name}")
                    fs.delete(p, True)
                    gone += 1
        for name in self._names("_commits"):
            if int(name.split(".")[0]) < n:
                fs, p = self._fs(f"{self.path}/_commits/{name}")
                fs.delete(p, False)
        return gone

    def repair(self) -> DataFrame:
        """Drop dangling edges and repeated contents; returns the integrity report from before."""
        from recall_spark.operators.observe import integrity, repaired

        neurons, synapses = self.read("neurons"), self.read("synapses")
        report = durable(integrity(neurons, synapses))
        n, s = repaired(neurons, synapses)
        self.commit({"neurons": durable(n), "synapses": durable(s)})
        return report
