"""Quality rules with thresholds learned per language and source.

Each measured share of a text goes into a log-linear histogram of integers (exact below
``2 * STEPS``, then ``STEPS`` steps to each power of two). Such a histogram is a quantile sketch
with relative error ``1 / STEPS`` whose merge is addition: partial sketches of one group, of all
sources of a language and of all languages are sums of counts, the same in whatever order they
come. A group is judged by fences around the quartiles of its own sketch and, as if it had ``PRIOR``
rows more, its language's, which in turn has as many of everyone's: so the fewer rows a group has, the
more it borrows, and there is no size at which the rule changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import cut, small_batches, whole_row

STEPS = 32
MIN_WORDS = 50
#: Share (per mille, of words unless said otherwise) -> slack added to the quartiles' distance, so
#: that a uniform group doesn't reject its own small deviations.
SHARES = {"symbols": 100, "dup_lines": 150, "repeats": 150, "capitals": 150, "word_len": 1000}
#: Shares that are also bounded from below.
TWO_SIDED = ("word_len",)
FENCE = 3
#: A parent's sketch is lent as so many evenly spaced quantiles, each counting as so many rows.
POINTS, WEIGHT = 16, 6
#: Groups up to which the fences are broadcast; with more of them rows are joined by a shuffle.
BROADCAST_GROUPS = 20_000

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
METRICS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,n_upper:bigint,n_letters:bigint>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_FIELDS = [x.split(":")[0] for x in METRICS[7:-1].split(",")]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The numbers of METRICS for UTF-8 ``text``; null counts as empty."""
    text = text or b""
    words = text.split()
    bare = text.translate(None, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    without = lambda drop: len(bare) - len(bare.translate(None, drop))
    return (len(words), chars, without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(_UPPER), without(_LETTERS))


def _measure(text: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in text]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(_FIELDS), names=_FIELDS)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as ``_row``, with ``_m`` (METRICS), ``_lang`` and ``_source`` beside it."""
    # Not deterministic, or a filter on the measures would have Spark take them once more.
    kept = small_batches(docs).select(whole_row(docs), F.arrow_udf(_measure, METRICS).asNondeterministic()(F.col(f"`{text_col}`").cast("binary")).alias("_m"))
    return kept.select("_row", "_m", F.col("_row.lang").alias("_lang"), F.col("_row.source").alias("_source"))


def base_failed(m: str = "_m") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * n)


def _share(name: str, m: str = "_m") -> Column:
    part, whole = {
        "symbols": ("n_symbols", "n_words"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "capitals": ("n_upper", "n_letters"),
        "word_len": ("word_chars", "n_words"),
    }[name]
    return F.expr(f"coalesce({m}.{part} * 1000 div nullif({m}.{whole}, 0), 0L)")


def bucket(v: Column) -> Column:
    """The sketch's bucket of a number that isn't negative, by its smallest value."""
    shift = F.greatest(F.length(F.bin(v)) - F.lit(STEPS.bit_length()), F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return v - v % step


def sketches(rows: DataFrame) -> DataFrame:
    """``(_lang, _source, share, bucket, n)`` of rows that the base rules keep: one small sketch a group."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), bucket(_share(k)).alias("bucket")) for k in SHARES])).alias("s")
    return rows.where(~base_failed()).select("_lang", "_source", one).select("_lang", "_source", "s.share", "s.bucket").groupBy("_lang", "_source", "share", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _ranked(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """A merged sketch with running and whole counts of each group and share."""
    by = ", ".join([*keys, "share"])
    merged = sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    return merged.selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as upto", f"sum(n) over (partition by {by}) as total")


def _points(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``POINTS`` evenly spaced quantiles of each group and share, as a sketch of weight ``POINTS * WEIGHT``."""
    below = lambda x: f"({2 * POINTS} * ({x}) div total + 1) div 2"
    return _ranked(sketch, keys).selectExpr(*keys, "share", "bucket", f"{WEIGHT} * ({below('upto')} - {below('upto - n')}) as n").where("n > 0")


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Fences of each group of ``keys`` and share."""
    at = lambda q: F.min(F.expr(f"case when upto * 4 >= total * {q} then bucket end"))
    q = _ranked(sketch, keys).groupBy(*keys, "share").agg(at(1).alias("q1"), at(3).alias("q3"))
    slack = F.create_map(*[F.lit(x) for k, v in SHARES.items() for x in (k, v)])[F.col("share")]
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), slack)
    low = F.when(F.col("share").isin(*TWO_SIDED), F.col("q1") - reach).otherwise(F.lit(-1).cast("long"))
    return q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("share", F.struct(low.alias("low"), (F.col("q3") + reach).alias("high"))))).alias("fences"))


def thresholds(rows: DataFrame) -> DataFrame:
    """``(_lang, _source, fences)``: one map of share to (low, high) for each group.

    The number of rows is that of the groups; each group's sketch has at most a few hundred buckets.
    """
    sketch = cut(sketches(rows))
    lent = F.broadcast(_points(sketch, []))  # At most POINTS rows for each share.
    langs = sketch.select("_lang", "share").distinct().join(lent, "share").select("_lang", "share", "bucket", "n")
    lang = _points(sketch.select("_lang", "share", "bucket", "n").unionByName(langs), ["_lang"]).withColumnRenamed("_lang", "_l").withColumnRenamed("share", "_k")
    groups = sketch.select("_lang", "_source", "share").distinct().join(lang, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("share") == F.col("_k")))
    return _fences(sketch.unionByName(groups.select(*sketch.columns)), ["_lang", "_source"])


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with ``base_failed`` and ``kept`` by a null-safe join on the group.

    The number of groups is counted first: up to ``BROADCAST_GROUPS`` the rows stay where they are.
    """
    fences = cut(fences)
    few = fences.count() <= BROADCAST_GROUPS
    f = (F.broadcast(fences) if few else fences).select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), "fences")
    joined = rows.join(f, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for k in SHARES:
        fence = F.col("fences")[k]
        inside &= F.coalesce(_share(k).between(fence["low"], fence["high"]), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & inside).drop("_l", "_s", "fences")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, metrics, ``base_failed`` and ``kept``; texts are read once.

    Null texts count as empty and fail the base rules; null languages and sources form groups of
    their own; an empty table gives an empty result; other columns are not read.
    """
    own = small_batches(docs).select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("_row"), F.arrow_udf(_measure, METRICS)(F.col(f"`{text_col}`").cast("binary")).alias("_m"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    narrow = cut(own)
    return judged(narrow, thresholds(narrow)).select("_row.id", "_m.*", "base_failed", "kept")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, whole and unchanged; the measures are computed once to learn
    the fences and once more in the filtering pass, so no text is shuffled to meet its own measures. Null
    texts go; repeated rows share their fate; an empty table gives an empty result."""
    rows = measured(docs, text_col)
    return judged(rows, thresholds(rows)).where("kept").select("_row.*")
