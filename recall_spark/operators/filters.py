"""Document filters compiled once to a Column.

Logic is two-valued: a comparison with a missing field is false before any negation, so ``$not``,
``$ne`` and ``$nin`` are true of it. With ``strict`` the wire interface's quirks hold as well:
numbers never equal integer fields, and timestamps are neither comparable nor sortable.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_spark.functions.re2 import to_java

#: Field of the interface -> column; anything else is a metadata key.
FIELDS = {
    "id": "neuron_id",
    "_id": "neuron_id",
    "content": "content",
    "energy": "energy",
    "depth": "depth",
    "tags": "tags",
    "accessCount": "access_count",
    "createdAt": "created_at",
    "lastFiredAt": "last_fired_at",
}
EDGE_FIELDS = {"_id": "synapse_id", "id": "synapse_id", "fromId": "from_id", "toId": "to_id", "weight": "weight", "coFireCount": "co_fire_count", "lastCoFire": "last_co_fire", "createdAt": "created_at"}
NUMERIC = ("energy", "depth", "access_count", "weight", "co_fire_count")
INTEGER = ("depth", "access_count", "co_fire_count")
TIMES = ("created_at", "last_fired_at", "last_co_fire")
_ORDERED = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def _known(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _compiles(pattern: str) -> bool:
    """Whether Java, which runs it, takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


class FilterCompiler:
    """Turns a filter dict into a boolean Column for ``where``.

    Where a field is missing the column may be null, which selects nothing; it is made false before
    any negation. Left bare otherwise, comparisons can be pushed into the scan.
    """

    def __init__(self, fields: dict[str, str] | None = None, strict: bool = False, metadata: bool = True) -> None:
        self.fields = FIELDS if fields is None else fields
        self.strict, self.metadata = strict, metadata

    def column(self, field: str) -> Column:
        if field in self.fields:
            return F.col(self.fields[field])
        return F.col("metadata")[field] if self.metadata else F.lit(None).cast("string")

    def compile(self, spec: dict[str, Any] | None) -> Column:
        """All entries must hold; no entries hold for every row."""
        return reduce(and_, (self._entry(k, v) for k, v in (spec or {}).items()), F.lit(True))

    def _entry(self, key: str, cond: Any) -> Column:
        if key.startswith("$"):
            return self._logical(key, cond)
        if isinstance(cond, dict):
            return reduce(and_, (self._operator(key, op, v) for op, v in cond.items()), F.lit(True))
        return self._equal(key, cond)

    def _logical(self, op: str, cond: Any) -> Column:
        if op in ("$and", "$or") and isinstance(cond, list):
            members = [self.compile(x) for x in cond if isinstance(x, dict)]
            return reduce(and_ if op == "$and" else or_, members, F.lit(op == "$and"))
        if op == "$not" and isinstance(cond, dict):
            return ~_known(self.compile(cond))
        return F.lit(False)

    def _kind(self, field: str) -> str:
        name = self.fields.get(field)
        return "number" if name in NUMERIC else "time" if name in TIMES else "tags" if name == "tags" else "string"

    def _equal(self, field: str, value: Any) -> Column:
        col, kind = self.column(field), self._kind(field)
        if value is None:
            return col.isNull()
        if kind == "number":
            if isinstance(value, bool) or not isinstance(value, (int, float)) or (self.strict and self.fields[field] in INTEGER):
                return F.lit(False)
            return col == F.lit(value)
        if kind == "time":
            return F.lit(False) if self.strict else col == F.lit(value).cast("timestamp_ntz")
        if kind == "tags":
            return col == F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(False)
        return col == F.lit(value) if isinstance(value, str) else F.lit(False)

    def _ordered(self, field: str, op: str, value: Any) -> Column:
        col, kind = self.column(field), self._kind(field)
        if kind == "time" and not self.strict and not isinstance(value, (int, float)):
            return getattr(col, _ORDERED[op])(F.lit(value).cast("timestamp_ntz"))
        if kind != "number" or isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return getattr(col, _ORDERED[op])(F.lit(value))

    def _operator(self, field: str, op: str, value: Any) -> Column:
        col, kind = self.column(field), self._kind(field)
        if op == "$eq":
            return self._equal(field, value)
        if op == "$ne":
            return ~_known(self._equal(field, value))
        if op in _ORDERED:
            return self._ordered(field, op, value)
        if op in ("$in", "$nin"):
            found = reduce(or_, (self._equal(field, v) for v in value), F.lit(False)) if isinstance(value, list) else F.lit(False)
            return found if op == "$in" else ~_known(found)
        if op == "$regex":
            if kind != "string" or not isinstance(value, str):
                return F.lit(False)
            java = to_java(value)
            return col.rlike(java) if java is not None and _compiles(java) else F.lit(False)
        if op == "$exists":
            if not isinstance(value, bool):
                raise ValueError("$exists takes true or false")
            return col.isNotNull() if value else col.isNull()
        if op == "$contains":
            if not isinstance(value, str):
                raise ValueError("$contains takes a string")
            return F.contains(F.lower(col), F.lit(value.lower())) if kind == "string" else F.lit(True)
        return F.lit(True)  # an unknown operator doesn't restrict


def compile_filter(spec: dict[str, Any] | None, strict: bool = False) -> Column:
    return FilterCompiler(strict=strict).compile(spec)


def metadata_matches(wanted: dict[str, str]) -> list[Column]:
    """One never-null boolean for each key that must have its value."""
    return [F.coalesce(F.col("metadata")[k] == F.lit(str(v)), F.lit(False)) for k, v in wanted.items()]


# Liveness and consolidation.
def alive(energy: str = "energy") -> Column:
    return F.col(energy) > 0.01


def dormant(energy: str = "energy") -> Column:
    return (F.col(energy) > 0) & (F.col(energy) <= 0.01)


def edge_alive(weight: str = "weight") -> Column:
    return F.col(weight) > 0.05


def edge_weak(weight: str = "weight") -> Column:
    return (F.col(weight) > 0) & (F.col(weight) <= 0.05)


def archivable(as_of: Column, weight: str = "weight", last: str = "last_co_fire") -> Column:
    return (F.col(weight) < 0.01) & (as_of - F.col(last) > F.expr("INTERVAL 30 DAYS"))


def consolidates(as_of: Column, accesses: int = 10, minutes: int = 30, below: float = 0.5) -> Column:
    return (F.col("access_count") >= accesses) & (as_of - F.col("created_at") >= F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("energy") < below)
