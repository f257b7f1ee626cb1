"""Token-budgeted context: a ranked prefix of results that fits, joined to one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 50
SEPARATOR = "\n---\n"


def within_budget(ranked: DataFrame, most: int, by: list[str] | None = None, order: str = "rank") -> DataFrame:
    """Rows in order up to the first that would exceed ``most`` tokens of 4 bytes; with ``tokens``
    and ``used``. ``by`` names the columns of a query."""
    tokens = F.floor(F.octet_length("content") / 4).cast("long")
    upto = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(upto)).where(F.col("used") <= most)


def assembled(ranked: DataFrame, most: int, by: list[str], order: str = "rank") -> DataFrame:
    """One context text for each query, deep nodes marked; the marks and separators cost nothing."""
    part = F.when(F.col("depth") > 0, F.concat("content", F.lit(" [depth:"), F.col("depth").cast("string"), F.lit("]"))).otherwise(F.col("content"))
    kept = within_budget(ranked, most, by, order)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"])
    return kept.groupBy(*by).agg(F.array_join(texts, SEPARATOR).alias("context"), F.count(F.lit(1)).alias("neurons_used"), F.max("used").alias("estimated_tokens"))
