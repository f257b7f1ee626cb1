"""Naming a value inside one expression, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once. A lambda that mentions an outer expression would
    evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(name: str, value: Column, keep: Callable[[Column], Column]) -> Column:
    """A generator that yields ``value`` as ``name`` where ``keep`` holds and no row elsewhere.

    A filter on a projected expression is pushed below the projection and evaluates it a second time;
    this is one evaluation for both.
    """
    return F.explode(F.filter(F.array(value), keep)).alias(name)
