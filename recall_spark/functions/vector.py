"""Vector functions on arrays; products are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_spark.functions.binding import let


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 where lengths differ."""
    total = F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null or empty vectors, other lengths and zero norms."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))).otherwise(0.0)


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine to one literal vector whose norm is folded on the driver."""
    size = sum(x * x for x in query) ** 0.5
    if not query or size == 0:
        return F.lit(0.0)
    unit = F.array(*[F.lit(float(x) / size) for x in query])
    n = norm(v)
    return F.when(v.isNotNull() & (F.size(v) == len(query)) & (n > 0), dot(v, unit) / n).otherwise(0.0)


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return let(F.struct(_wide(v).alias("v"), norm(v).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))


def lerp(a: Column, b: Column, by: Column | float) -> Column:
    """Each coordinate moved from ``a`` towards ``b`` by a share."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.zip_with(a, b, lambda x, y: x + (y - x) * by)


def clamped(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
