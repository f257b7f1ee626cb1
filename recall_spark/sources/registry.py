"""The index registry as DataFrame transformations over one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark import schema
from recall_spark.errors import UUIDConflict, UUIDNotFound, UUIDRequired


class Registry:
    """Entries ``(uuid, metadata, created_at, updated_at)``; every change returns a new registry."""

    def __init__(self, entries: DataFrame) -> None:
        self.entries = entries

    @classmethod
    def empty(cls, spark: SparkSession) -> Registry:
        return cls(spark.createDataFrame([], schema.REGISTRY_DDL))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """From a JSON file: one array or one entry a line."""
        return cls(spark.read.schema(schema.REGISTRY_DDL).option("multiLine", True).json(path))

    def save(self, path: str) -> None:
        self.entries.coalesce(1).write.mode("overwrite").json(path)

    def get(self, uuid: str) -> DataFrame:
        return self.entries.where(F.col("uuid") == uuid)

    def exists(self, uuid: str) -> bool:
        return not self.get(uuid).limit(1).isEmpty()

    def list(self) -> DataFrame:
        return self.entries.orderBy("uuid")

    def count(self) -> int:
        return self.entries.count()

    def _row(self, uuid: str, metadata: dict[str, str] | None, as_of: str) -> DataFrame:
        if not (uuid or "").strip():
            raise UUIDRequired("an entry needs an id")
        pairs = [F.lit(str(x)) for kv in (metadata or {}).items() for x in kv]
        own = F.create_map(*pairs) if pairs else F.lit(None)
        at = F.lit(as_of).cast("timestamp_ntz")
        return self.entries.sparkSession.range(1).select(F.lit(uuid).alias("uuid"), own.cast("map<string,string>").alias("metadata"), at.alias("created_at"), at.alias("updated_at"))

    def create(self, uuid: str, metadata: dict[str, str] | None, as_of: str) -> Registry:
        row = self._row(uuid, metadata, as_of)
        if self.exists(uuid):
            raise UUIDConflict(f"there already: {uuid}")
        return Registry(self.entries.unionByName(row))

    def find_or_create(self, uuid: str, metadata: dict[str, str] | None, as_of: str) -> tuple[Registry, bool]:
        if self.exists(uuid):
            return self, False
        return self.create(uuid, metadata, as_of), True

    def update(self, uuid: str, as_of: str, metadata: dict[str, str] | None = None, rename: str | None = None) -> Registry:
        """New metadata, a new id, or both; the old entry keeps what isn't given."""
        if not self.exists(uuid):
            raise UUIDNotFound(f"not registered: {uuid}")
        if rename and rename != uuid and self.exists(rename):
            raise UUIDConflict(f"there already: {rename}")
        hit = F.col("uuid") == uuid
        fresh = F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv]) if metadata else F.col("metadata")
        return Registry(
            self.entries.select(
                F.when(hit, F.lit(rename or uuid)).otherwise(F.col("uuid")).alias("uuid"),
                F.when(hit, fresh).otherwise(F.col("metadata")).alias("metadata"),
                "created_at",
                F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")).alias("updated_at"),
            )
        )

    def delete(self, uuid: str) -> Registry:
        if not self.exists(uuid):
            raise UUIDNotFound(f"not registered: {uuid}")
        return Registry(self.entries.where(F.col("uuid") != uuid))

    def upserted(self, rows: DataFrame) -> Registry:
        """Many entries at once: what is there keeps its creation time, the rest is appended."""
        now = rows.select("uuid", F.col("metadata").alias("_m"), F.col("updated_at").alias("_u"), F.col("created_at").alias("_c"))
        both = self.entries.join(now, "uuid", "full")
        return Registry(both.select("uuid", F.coalesce("_m", "metadata").alias("metadata"), F.coalesce("created_at", "_c").alias("created_at"), F.coalesce("_u", "updated_at").alias("updated_at")))
