"""Language identification by cross-parsing against suffix automata.

From labelled text of each language a suffix automaton is built. A text is cut, left to right, into
the longest phrases that occur in a language's labelled text (cross-parsing, Ziv and Merhav 1993);
the number of phrases, weighted by the bits that name a place in the model, estimates the cross
entropy. The language with the fewest weighted phrases wins.

Texts are lower-cased and parsed as UTF-8 bytes, so every script has an alphabet of at most 256
symbols and no character stands for another. Bytes that a language's labelled text doesn't hold
extend no phrase of it, whichever they are.

The model is fitted on a bounded sample: about ``rows_per_lang`` labelled rows of each language, whole,
of up to ``row_chars`` code points (longer ones where a language has no others). Everything else covers
all rows, all languages and whole texts. For speed a text is parsed in stretches side by side, each
from a guessed state; stretches whose guess was wrong are parsed again from the state that the one
before ended in, until all agree. So the phrases are those of a parse from left to right.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.llm.common import small_batches

STRETCH = 256
LETTER = r"\p{L}"
_BATCH = 1 << 21
_WIDE = 1 << 13
#: What fills up the last stretch of a text; no byte.
PAD = 256


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Automaton:
    """Suffix automaton of a byte sequence as one dense table over the bytes that it holds.

    ``table[state * symbols + code]`` is the next state, or ``~restart`` where the phrase ends:
    the state after ``code`` alone. The last two columns are for other bytes, which end a phrase, and
    for padding, which keeps every state as it is.
    """

    def __init__(self, text: bytes) -> None:
        raw = np.frombuffer(text, np.uint8)
        own = np.unique(raw)
        symbols = len(own) + 2
        self.code = np.full(257, symbols - 2, np.uint16)
        self.code[own] = np.arange(len(own))
        self.code[PAD] = symbols - 1
        codes = self.code[raw]
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = twin
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = now
        fresh = np.zeros(symbols, np.int32)
        for c, to in step[0].items():
            fresh[c] = to
        table = np.tile(~fresh, (len(step), 1))
        for state, own in enumerate(step):
            if own:
                table[state, list(own)] = list(own.values())
        table[:, symbols - 1] = np.arange(len(step))
        self.table, self.bits, self.symbols = table.ravel(), math.log2(max(2, len(codes))), symbols

    def parse(self, stretches: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases end inside each column of ``stretches`` (bytes, padded), parsed from state
        ``start``, and the state then."""
        state = start.astype(np.int32)
        ended = np.zeros(stretches.shape[1], np.int32)
        for row in stretches:
            state *= self.symbols
            state += self.code[row]
            state = self.table[state]
            over = state >> 31
            ended -= over
            state ^= over
        return ended, state

    def phrases(self, stretches: np.ndarray, before: np.ndarray) -> np.ndarray:
        """As ``parse``, but each column goes on where column ``before`` ended; -1 is a text's start."""
        start = np.zeros(stretches.shape[1], np.int32)
        ended, end = start.copy(), start.copy()
        todo = np.arange(len(start))
        while len(todo):
            for at in range(0, len(todo), _WIDE):
                some = todo[at : at + _WIDE]
                ended[some], end[some] = self.parse(stretches[:, some], start[some])
            real = np.where(before >= 0, end[before], 0)
            todo = np.flatnonzero(real != start)
            start = real
        return ended


class Model:
    """Automata of all learned languages."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.automata = [Automaton(encoded(samples[k])) for k in self.langs]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits of weighted phrases for each text and language."""
        raw = [encoded(x) for x in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        every = np.frombuffer(b"".join(raw), np.uint8)
        pieces = np.maximum(1, -(-sizes // STRETCH))
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        before = np.where(nth > 0, np.arange(len(owner)) - 1, -1)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * STRETCH
        size = np.minimum(STRETCH, np.repeat(sizes, pieces) - nth * STRETCH)
        row = np.arange(int(size.max(initial=0)))[:, None]
        grid = np.full((len(row), len(owner)), PAD, np.uint16)
        inside = row < size
        grid[inside] = every[(start + row)[inside]]
        out = np.zeros((len(texts), len(self.langs)))
        for k, automaton in enumerate(self.automata):
            ended = np.bincount(owner, automaton.phrases(grid, before), len(texts)) + 1
            out[:, k] = ended * automaton.bits
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score: by how much the second best needs more, 0 to 1. Ties go to the first name."""
        langs: list[str] = []
        scores: list[float] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= _BATCH):
                chars += len(texts[to])
                to += 1
            cost = self.costs(texts[at:to])
            best = cost.argmin(axis=1)
            low = cost.min(axis=1)
            rest = cost.copy()
            rest[np.arange(len(rest)), best] = np.inf
            second = rest.min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(np.isinf(second), 1.0, np.where(second > 0, 1 - low / second, 0.0))
            langs += [self.langs[b] for b in best]
            scores += [float(x) for x in np.clip(score, 0, 1)]
            at = to
        return langs, scores


def sample(labelled: DataFrame, rows_per_lang: int = 24, row_chars: int = 10_000, salt: int = 8) -> dict[str, str]:
    """Text of each language of ``labelled(id, text, lang)``, to fit the automata on.

    Of each language the rows least by hash in ``salt`` classes of ids are taken, so that a language
    with most of the rows is spread over many tasks; rows of more than ``row_chars`` code points come
    after all others. What reaches the driver and each worker grows with the number of languages only.
    """
    quota = -(-rows_per_lang // salt)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    h = F.xxhash64(F.col("id").cast("string"))
    part = Window.partitionBy("lang", "salt").orderBy("long", "h", "mark")
    own = usable.select("lang", "text", h.alias("h"), F.xxhash64("text").alias("mark"), (F.length("text") > row_chars).alias("long"))
    rows = own.withColumn("salt", F.pmod(F.xxhash64("h", "mark"), F.lit(salt))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= quota).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.long, r.n, r.h, r.mark)):
        if len(found.setdefault(r.lang, [])) < rows_per_lang and not (r.long and found[r.lang]):
            found[r.lang].append(r.text)
    return {k: "\n".join(v) for k, v in found.items()}


_CACHE: dict[int, Model] = {}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned.
    Each Python worker builds the automata once; texts come by Arrow and are parsed whole.
    """
    key = hash(tuple(sorted(samples.items())))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def parse(text: pa.Array) -> pa.Array:
        if key not in _CACHE:
            _CACHE.clear()
            _CACHE[key] = Model(samples)
        langs, scores = _CACHE[key].predict([x.as_py() or "" for x in text])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    text = F.col(f"`{text_col}`")
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.when(text.rlike(LETTER), text).alias("t"))
    if not samples:
        return rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.select("id", F.col("t").isNotNull().alias("some"), parse("t").alias("p"))
    return found.select("id", F.when(F.col("some"), F.col("p.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("some"), F.col("p.score")).otherwise(0.0).alias("score"))
