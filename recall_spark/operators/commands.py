"""The command language: find, findOne, count, search, stats, insert, over a pluggable registry."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.errors import EngineError, InvalidJSON, MutationDisabled
from recall_spark.operators.filters import EDGE_FIELDS, FIELDS, TIMES, FilterCompiler

#: Fields of a document, in order, and their columns.
DOCUMENT = {
    "_id": "neuron_id",
    "content": "content",
    "energy": "energy",
    "depth": "depth",
    "position": "position",
    "tags": "tags",
    "metadata": "metadata",
    "accessCount": "access_count",
    "createdAt": "created_at",
    "lastFiredAt": "last_fired_at",
}
EDGE_DOCUMENT = {k: v for k, v in EDGE_FIELDS.items() if k != "id"}
BLOCKED = ("update", "updateOne", "delete", "deleteOne", "activate")


@dataclass
class Command:
    """One parsed command envelope."""

    type: str
    collection: str = "neurons"
    document: dict[str, Any] = field(default_factory=dict)
    filter: dict[str, Any] = field(default_factory=dict)
    update: dict[str, Any] = field(default_factory=dict)
    pipeline: list[dict[str, Any]] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)


def parse_command(text: str | dict[str, Any]) -> Command:
    try:
        raw = json.loads(text) if isinstance(text, str) else dict(text)
    except ValueError as e:
        raise InvalidJSON(str(e)) from e
    if not isinstance(raw, dict):
        raise InvalidJSON("a command is an object")
    known = {k: raw[k] for k in Command.__dataclass_fields__ if raw.get(k) is not None}
    return Command(**({"type": ""} | known))


def projection(spec: dict[str, int] | None, document: dict[str, str] = DOCUMENT, strict: bool = False) -> list[Column]:
    """Columns of a document: those included, or all but those excluded.

    ``strict`` keeps only fields that are set to other than zero, so a pure exclusion leaves nothing.
    """
    if not spec:
        names = list(document)
    elif any(spec.values()) or strict:
        names = [k for k in document if spec.get(k)]
    else:
        names = [k for k in document if k not in spec]
    return [F.col(document[k]).alias(k) for k in names]


def ordering(sort: dict[str, int] | list[tuple[str, int]] | None, strict: bool = False) -> list[Column]:
    """Sort keys in the given order, energy descending by default, with the id to break ties."""
    keys = list(sort.items()) if isinstance(sort, dict) else list(sort or [("energy", -1)])
    out = []
    for name, way in keys:
        column = FIELDS.get(name)
        if strict and column in TIMES:
            continue
        c = F.col(column) if column else F.col("metadata")[name]
        out.append(c.desc_nulls_last() if way < 0 else c.asc_nulls_first())
    return [*out, F.col("neuron_id").asc()]


def page(df: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    df = df.offset(skip) if skip > 0 else df
    return df.limit(limit) if limit and limit > 0 else df


def find(neurons: DataFrame, spec: dict[str, Any] | None = None, sort=None, skip: int = 0, limit: int | None = None, fields: dict[str, int] | None = None, strict: bool = False) -> DataFrame:
    """Documents that fit a filter, sorted, paged and projected; the filter reaches the scan."""
    found = neurons.where(FilterCompiler(strict=strict).compile(spec))
    return page(found.orderBy(*ordering(sort, strict)), skip, limit).select(*projection(fields, strict=strict))


def find_synapses(synapses: DataFrame, spec: dict[str, Any] | None = None, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Edge documents; filter and limit are an extension that ``strict`` turns off."""
    if not strict:
        synapses = synapses.where(FilterCompiler(EDGE_FIELDS, metadata=False).compile(spec))
        if limit:
            synapses = synapses.orderBy("synapse_id").limit(limit)
    return synapses.select(*projection(None, EDGE_DOCUMENT))


def count(neurons: DataFrame, spec: dict[str, Any] | None = None, strict: bool = False) -> DataFrame:
    return neurons.where(FilterCompiler(strict=strict).compile(spec)).agg(F.count(F.lit(1)).alias("count"))


_GROUPS: dict[str, Callable[[Column], Column]] = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}


def aggregate(neurons: DataFrame, stages: list[dict[str, Any]]) -> DataFrame:
    """An optional pipeline of ``$match``, ``$group``, ``$sort``, ``$skip``, ``$limit`` and ``$project``."""
    df, fields = neurons, dict(FIELDS)

    def named(ref: Any) -> Column:
        if not (isinstance(ref, str) and ref.startswith("$")):
            return F.lit(ref)
        return F.col(fields[ref[1:]]) if ref[1:] in fields else F.col("metadata")[ref[1:]]

    for stage in stages:
        ((op, spec),) = stage.items()
        if op == "$match":
            df = df.where(FilterCompiler(fields, metadata="metadata" in df.columns).compile(spec))
        elif op == "$group":
            aggs = [(_GROUPS[fn](named(ref))).alias(out) for out, x in spec.items() if out != "_id" for fn, ref in x.items()]
            df = df.groupBy(named(spec.get("_id")).alias("_id")).agg(*aggs)
            fields = {c: c for c in df.columns}
        elif op == "$sort":
            df = df.orderBy(*[named(f"${k}").desc() if v < 0 else named(f"${k}").asc() for k, v in spec.items()])
        elif op == "$skip":
            df = df.offset(int(spec))
        elif op == "$limit":
            df = df.limit(int(spec))
        elif op == "$project":
            df = df.select(*[named(f"${k}").alias(k) for k, v in spec.items() if v])
            fields = {c: c for c in df.columns}
        else:
            raise EngineError(f"unknown pipeline stage: {op}", "BAD_REQUEST")
    return df


Handler = Callable[[Any, Command], Any]


class CommandRegistry:
    """Handlers by command type; any may be added, replaced or removed."""

    def __init__(self, strict: bool = False, pipelines: bool = False) -> None:
        self.strict = strict
        self._handlers: dict[str, Handler] = {
            "find": self._find,
            "findOne": self._find_one,
            "count": lambda e, c: count(e.neurons, c.filter, self.strict),
            "search": lambda e, c: e.search(c.filter.get("query") or c.document.get("query") or "", depth=c.options.get("depth"), limit=c.options.get("limit")).result,
            "stats": lambda e, c: e.stats(),
            "insert": lambda e, c: e.write([c.document]),
        }
        if pipelines:
            self._handlers["aggregate"] = lambda e, c: aggregate(e.neurons, c.pipeline)

    def register(self, name: str, handler: Handler) -> None:
        self._handlers[name] = handler

    def unregister(self, name: str) -> None:
        self._handlers.pop(name, None)

    def list(self) -> list[str]:
        return sorted(self._handlers)

    def execute(self, engine: Any, command: str | dict[str, Any] | Command) -> Any:
        cmd = command if isinstance(command, Command) else parse_command(command)
        if cmd.type in BLOCKED:
            raise MutationDisabled(f"mutation by command is off: {cmd.type}")
        if cmd.type not in self._handlers:
            raise EngineError(f"unknown command type: {cmd.type}", "BAD_REQUEST")
        return self._handlers[cmd.type](engine, cmd)

    def _find(self, engine: Any, cmd: Command) -> DataFrame:
        o = cmd.options
        if cmd.collection == "synapses":
            return find_synapses(engine.synapses, cmd.filter, o.get("limit"), self.strict)
        if cmd.collection != "neurons":
            return find(engine.neurons, {"$or": []})
        return find(engine.neurons, cmd.filter, o.get("sort"), int(o.get("skip") or 0), o.get("limit"), o.get("projection"), self.strict)

    def _find_one(self, engine: Any, cmd: Command) -> DataFrame:
        return self._find(engine, Command("find", cmd.collection, filter=cmd.filter, options=cmd.options | {"limit": 1}))
