"""Ranked search: lexical and vector relevance times the memory's dynamics.

Single queries are one JVM expression; batches of queries are matrix products on Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recall_spark.functions import sentiment as S
from recall_spark.functions import text as X
from recall_spark.functions import vector as V
from recall_spark.functions.binding import let, once
from recall_spark.operators.filters import metadata_matches


def _keyed(tokens: Column) -> Column:
    """Tokens with their first 3 bytes, which is null for those of 3 bytes or less."""
    prefix = lambda t: F.when(F.octet_length(t) > 3, F.substring(F.encode(t, "UTF-8"), 1, 3))
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), prefix(t).alias("p")))


def _any_hit(words: list[str]) -> Callable[[Column], Column]:
    """Whether a token can be hit by any of ``words``."""
    heads = {w.encode()[:3] for w in words if len(w.encode()) > 3}

    def head(t: Column, h: bytes) -> Column:
        try:
            return F.startswith(t, F.lit(h.decode()))
        except UnicodeDecodeError:
            return F.substring(F.encode(t, "UTF-8"), 1, 3) == F.lit(h)

    return lambda t: reduce(or_, [head(t, h) for h in sorted(heads)], t.isin(sorted({w for w in words if len(w.encode()) <= 3})) if any(len(w.encode()) <= 3 for w in words) else F.lit(False))


def lexical(content: Column, tokens: Column, query: Column, query_tokens: Column, words: list[str] | None = None) -> Column:
    """Phrase, token overlap and bounded edit-distance credit of content for a query (both columns or
    literals). Of a literal query, ``words`` are its tokens: only content tokens that these can hit are
    looked at more closely.

    A query token counts for the first content token that equals it or, both over 3 bytes, shares its
    first 3 bytes; the latter has extra credit. ``query_tokens`` keeps repeats: each counts.
    """
    low = F.lower(query)
    phrase = F.when(F.contains(F.lower(content), low), 10.0).otherwise(0.0)

    def kind(q: Column, own: Column) -> Column:
        hit = F.get(F.filter(own, lambda t: (t["t"] == q["t"]) | (t["p"] == q["p"])), F.lit(0))
        return let(hit, lambda h: F.when(h.isNull(), 0).when(h["t"] == q["t"], 1).otherwise(2))

    def overlap(kinds: Column) -> Column:
        matched = F.size(F.filter(kinds, lambda k: k > 0))
        partial = F.size(F.filter(kinds, lambda k: k == 2))
        return phrase + 0.3 * partial + F.when(F.size(kinds) > 0, matched / F.size(kinds) * 5.0).otherwise(0.0)

    def score(every: Column, own: Column) -> Column:
        kinds = F.transform(_keyed(query_tokens), lambda q: kind(q, own))
        return let(let(kinds, overlap), lambda base: base + F.when((F.octet_length(query) <= 20) & (base < 8.0), _fuzzy(F.slice(every, 1, 8), low)).otherwise(0.0))

    near = (lambda every: F.filter(every, _any_hit(words))) if words else (lambda every: every)
    return let(tokens, lambda every: let(_keyed(near(every)), lambda own: score(every, own)))


def _fuzzy(tokens: Column, low: Column) -> Column:
    def credit(t: Column) -> Column:
        most = F.greatest(F.octet_length(low), F.octet_length(t))
        return let(1.0 - F.levenshtein(low, t) / most, lambda alike: F.when(alike > 0.7, alike * 2.0).otherwise(0.0))

    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + credit(t))


def blended(lexical_score: Column, vector_score: Column, has_both: Column, alpha: float) -> Column:
    """Weighted vector and squashed lexical score where both sides have a vector, else the raw one."""
    return F.when(has_both, alpha * vector_score + (1 - alpha) * F.tanh(lexical_score / 10.0)).otherwise(lexical_score)


def hours_since(as_of: Column, ts: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(as_of) - micros(ts)) / 3.6e9


def dynamics(as_of: Column) -> Column:
    """Energy, recency, access and depth multipliers."""
    energy = 0.5 + 0.5 * F.col("energy")
    recency = 0.8 + 0.2 / (1.0 + hours_since(as_of, F.col("last_fired_at")) / 24.0)
    access = 1.0 + 0.1 * F.log10(F.col("access_count") + 1.0)
    return energy * recency * access * (1.0 / (1.0 + 0.2 * F.col("depth")))


def metadata_factor(wanted: dict[str, str] | None, strict: bool = False) -> Column:
    """1.3, 1.6, ... by matching keys; 0 in strict mode unless all match."""
    if not wanted:
        return F.lit(1.0)
    hits = metadata_matches(wanted)
    n = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    soft = 1.0 + 0.3 * n
    return F.when(n < len(hits), 0.0).otherwise(soft) if strict else soft


def scored(nodes: DataFrame, query: str, as_of: Column, *, query_vector: list[float] | None = None, query_label: str | None = None, metadata: dict[str, str] | None = None, strict: bool = False, alpha: float = 0.6) -> DataFrame:
    """``nodes`` with a positive ``score`` for one literal query.

    A query without tokens gives no rows. Columns a node table lacks (``tokens``, ``embedding``,
    ``sentiment_label``) are derived or left out of the formula.
    """
    words = X.query_tokens(query)
    if not words:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    tokens = F.col("tokens") if "tokens" in nodes.columns else X.tokens(F.col("content"))
    lex = lexical(F.col("content"), tokens, F.lit(query), F.array(*[F.lit(w) for w in words]), words)
    if query_vector is not None and "embedding" in nodes.columns:
        vec = F.greatest(F.lit(0.0), V.cosine_to(F.col("embedding"), query_vector))
        lex = blended(lex, vec, F.col("embedding").isNotNull() & (F.size("embedding") > 0), alpha)
    mood = S.factor(F.lit(query_label), F.col("sentiment_label")) if query_label and "sentiment_label" in nodes.columns else F.lit(1.0)
    base = nodes.select("*", once("_base", lex, lambda b: b > 0))
    out = base.withColumn("score", F.col("_base") * dynamics(as_of) * mood * metadata_factor(metadata, strict))
    return out.where("score > 0").drop("_base")


class _Asked:
    """A block of queries as two matrices, so that all of them meet a batch of nodes in two products.

    A content token stands under a key: its first 3 bytes, or all of it if it has no more. The first
    token of a node under a key is what a query token with that key hits. So how many tokens of a query
    hit is a sum over keys a node has, and how many hit themselves one over its first tokens.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.ids, self.indexes, self.texts = [r[0] for r in rows], np.array([r[1] for r in rows], object), [r[2] for r in rows]
        self.low = [t.lower() for t in self.texts]
        words = [list(r[3]) for r in rows]
        self.size = np.array([len(w) for w in words], np.float64)
        self.keys: dict[bytes, int] = {}
        self.firsts: dict[str, int] = {}
        hits, long, self_hits = Counter(), Counter(), Counter()
        for q, own in enumerate(words):
            for w in own:
                raw = w.encode()
                key = self.keys.setdefault(raw[:3], len(self.keys)) if len(raw) > 3 else self.keys.setdefault(b"=" + raw, len(self.keys))
                hits[key, q] += 1
                if len(raw) > 3:
                    long[key, q] += 1
                    self_hits[self.firsts.setdefault(w, len(self.firsts)), q] += 1
        matrix = lambda counts, n: _filled(counts, (n, len(rows)))
        self.hits, self.long, self.self_hits = matrix(hits, len(self.keys)), matrix(long, len(self.keys)), matrix(self_hits, len(self.firsts))

    def scores(self, indexes: list, contents: list[str], tokens: list[list[str]]) -> np.ndarray:
        """Lexical score of each node (row) for each query (column); 0 in other indexes."""
        n = len(contents)
        has, first = np.zeros((n, len(self.keys)), np.float32), np.zeros((n, len(self.firsts)), np.float32)
        for i, own in enumerate(tokens):
            for w in dict.fromkeys(own):
                raw = w.encode()
                key = self.keys.get(raw[:3] if len(raw) > 3 else b"=" + raw)
                if key is not None and not has[i, key]:
                    has[i, key] = 1
                    at = self.firsts.get(w)
                    if at is not None:
                        first[i, at] = 1
        matched = (has @ self.hits).astype(np.float64)
        partial = (has @ self.long - first @ self.self_hits).astype(np.float64)
        phrase = np.zeros(matched.shape)
        low: dict[int, str] = {}
        # A text that holds a query holds all its tokens, but for the first and the last.
        for i, q in zip(*np.nonzero(matched >= self.size - 2)):
            if self.low[q] in low.setdefault(i, contents[i].lower()):
                phrase[i, q] = 10.0
        out = phrase + 0.3 * partial + matched / self.size * 5.0
        for q in [q for q, t in enumerate(self.texts) if len(t.encode()) <= 20]:
            for i in np.flatnonzero(out[:, q] < 8.0):
                out[i, q] += sum(_credit(self.low[q], t) for t in tokens[i][:8])
        mine = np.array([x is None for x in self.indexes]) | (np.array(indexes, object)[:, None] == self.indexes)
        return np.where(mine, out, 0.0)


def _filled(counts: Counter, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    for at, n in counts.items():
        out[at] = n
    return out


@lru_cache(1 << 16)
def _credit(low: str, token: str) -> float:
    """``_fuzzy`` of one token."""
    row = list(range(len(token) + 1))
    for i, a in enumerate(low, 1):
        left, row[0] = row[0], i
        for j, b in enumerate(token, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a != b))
    alike = 1.0 - row[-1] / max(len(low.encode()), len(token.encode()))
    return alike * 2.0 if alike > 0.7 else 0.0


def batch(nodes: DataFrame, queries: DataFrame, as_of: Column, k: int = 20, block: int = 1000) -> DataFrame:
    """Top ``k`` nodes for each of ``queries(query_id, index_id, query)``: ``(query_id, rank, index_id,
    neuron_id, score)``. A null ``index_id`` asks every index.

    The queries are a stated set, read in blocks; each block meets every node, batch by batch, as
    matrix products over the tokens that the block asks for. A batch gives on its best ``k`` for each
    query, so what is shuffled to be ranked doesn't depend on how many nodes score.
    """
    asked = queries.select("query_id", "index_id", "query", X.tokens(F.col("query")).alias("query_tokens")).where(F.size("query_tokens") > 0)
    tokens = F.col("tokens") if "tokens" in nodes.columns else X.tokens(F.col("content"))
    prepared = nodes.select("index_id", "neuron_id", "content", tokens.alias("tokens"), dynamics(as_of).alias("dynamics"))
    kind = queries.schema["query_id"].dataType
    kinds = (to_arrow_type(kind), pa.string(), pa.string(), pa.float64())
    out = None
    blocks = -(-max(1, asked.count()) // block)
    for b in range(blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("query_id", "index_id", "query"), F.lit(blocks)) == b).collect()]
        found = prepared.mapInArrow(_best(rows, k, kinds), f"query_id {kind.simpleString()}, index_id string, neuron_id string, score double")
        out = found if out is None else out.unionByName(found)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "neuron_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "index_id", "neuron_id", "score")


def _best(rows: list[tuple], k: int, kinds: tuple):
    def run(batches):
        asked = _Asked(rows) if rows else None
        for part in batches:
            for at in range(0, part.num_rows if rows else 0, 256):
                own = part.slice(at, 256)
                index, neuron, content, tokens, dyn = (own.column(c).to_pylist() for c in range(5))
                scores = asked.scores(index, [c or "" for c in content], [t or [] for t in tokens]) * np.array(dyn, np.float64)[:, None]
                order = sorted(range(len(neuron)), key=lambda i: (neuron[i] is not None, neuron[i] or ""))
                ranked = scores[order]
                got: list[tuple] = []
                for q, best in enumerate(np.argsort(-ranked, axis=0, kind="stable")[:k].T):
                    got += [(asked.ids[q], index[order[i]], neuron[order[i]], float(ranked[i, q])) for i in best if ranked[i, q] > 0]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=["query_id", "index_id", "neuron_id", "score"])

    return run


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.asc("neuron_id")).limit(k)
