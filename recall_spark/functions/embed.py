"""Embedders: strategies that turn a text column into a unit vector column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions import text as X
from recall_spark.functions import vector as V
from recall_spark.functions.binding import let


class HashingEmbedder:
    """Signed feature hashing of tokens into ``dim`` numbers: no model, the same on every machine."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def column(self, text: Column) -> Column:
        """Each token adds its sign to one number of the vector; tokens are hashed once."""
        signed = lambda h: F.struct(F.pmod(h, F.lit(self.dim)).cast("int").alias("i"), F.when(F.shiftrightunsigned(h, 63) == 0, 1.0).otherwise(-1.0).alias("s"))
        marks = F.transform(X.tokens(X.clean(text)), lambda t: signed(F.xxhash64(t)))
        total = lambda own, i: F.aggregate(F.filter(own, lambda m: m["i"] == i), F.lit(0.0), lambda s, m: s + m["s"])
        return V.normalised(let(marks, lambda own: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: total(own, i)))).cast("array<float>")

    def embed(self, df: DataFrame, text_col: str = "content") -> DataFrame:
        return df.withColumn("embedding", self.column(F.col(text_col)))


class PrecomputedEmbedder:
    """Vectors that a table already holds, joined on an id."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        self.vectors = vectors.select(F.col(id_col).alias("_vid"), F.col(vector_col).alias("_vec"))

    def embed(self, df: DataFrame, on: str) -> DataFrame:
        return df.drop("embedding").join(self.vectors, F.col(on) == F.col("_vid"), "left").withColumnRenamed("_vec", "embedding").drop("_vid")


class FunctionEmbedder:
    """A user's vectorised function (a pandas UDF, say) from a text column to a vector column."""

    def __init__(self, fn: Callable[[Column], Column]) -> None:
        self.fn = fn

    def embed(self, df: DataFrame, text_col: str = "content") -> DataFrame:
        return df.withColumn("embedding", V.normalised(self.fn(F.col(text_col))).cast("array<float>"))


def embedded_chunks(df: DataFrame, embedder: HashingEmbedder, keys: list[str], text_col: str = "content", most: int = 384) -> DataFrame:
    """One unit vector for each key: the mean of its chunks' vectors, element by element."""
    parts = df.select(*keys, F.explode(X.chunks(X.clean(F.col(text_col)), most)).alias("_chunk"))
    flat = embedder.embed(parts, "_chunk").select(*keys, F.posexplode("embedding").alias("_i", "_x"))
    mean = flat.groupBy(*keys, "_i").agg(F.avg("_x").alias("_x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return mean.select(*keys, V.normalised(F.transform("_v", lambda p: p["_x"])).cast("array<float>").alias("embedding"))
