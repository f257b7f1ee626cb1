"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are folded: letters lower-cased one by one, each run of white space one space. An
item of m characters may occur with up to ``k = min(EDIT_RATE * m, (m - Q) // Q)`` edits. Such an
occurrence shares at least ``m - Q + 1 - Q * k`` character q-grams with the item (Jokinen and
Ukkonen, 1991), and they lie within ``k + 1`` neighbouring diagonals. So the q-grams that a text
shares with an item are counted in overlapping bands of ``2 * (k + 1)`` diagonals, bands that meet
the bound are retained, and a banded alignment verifies each.

The items are a stated query set: they are read in blocks of about ``block_chars`` characters, and
each block is looked for in every whole text. Texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import small_batches

Q = 8
EDIT_RATE = 0.1
LEAKS = "array<struct<item:int,start:int,end:int,edits:int>>"
_SPACE = ord(" ")
_STRETCH = 1 << 12
#: Places that a gram can have in an item and still be paired one by one.
_FEW = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    if not _FOLD:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            x = chr(c)
            low = x.lower()
            table[c] = _SPACE if x.isspace() else ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and where each stands in ``text``."""
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def trimmed(codes: np.ndarray) -> np.ndarray:
    inside = np.flatnonzero(codes != _SPACE)
    return codes[inside[0] : inside[-1] + 1] if len(inside) else codes[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of each of the q-grams (Q is 8) by doubling."""
    h = codes.astype(np.uint64)
    for width in (1, 2, 4):
        power = np.uint64(pow(int(_BASE), width, 1 << 64))
        h = h[:-width] * power + h[width:]
    return h


def alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """``(start, end, edits)`` of the best occurrence of ``item`` in ``text`` with at most ``most``
    edits whose path stays on diagonals ``low`` to before ``high``; the leftmost end wins."""

    def last_row(p: np.ndarray, t: np.ndarray, low: int, high: int, free: bool) -> np.ndarray:
        d = np.arange(low, high)
        row = np.where(d >= 0, 0 if free else np.abs(d), most + 1).astype(np.int64)
        row[d > len(t)] = most + 1
        step = np.arange(len(d))
        for j in range(len(p)):
            at = j + d
            ok = (at >= 0) & (at < len(t))
            same = np.zeros(len(d), bool)
            same[ok] = t[at[ok]] == p[j]
            new = np.where(ok, row + ~same, most + 1)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            new = np.minimum.accumulate(new - step) + step
            new[(at + 1 < 0) | (at + 1 > len(t))] = most + 1
            if new.min() > most:
                return new
            row = new
        return row

    m = len(item)
    ends = last_row(item, text, low, high, True)
    if ends.min() > most:
        return None
    end = m + low + int(ends.argmin())
    # Backwards from that end, the start is found on the same diagonals.
    back = last_row(item[::-1], text[:end][::-1], -most, most + 1, False)
    start = end - (m - most + int(back.argmin()))
    return max(0, start), end, int(ends.min())


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[str | None]) -> None:
        self.items = [trimmed(folded(x)[0]) if x else np.zeros(0, np.uint32) for x in items]
        size = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.maximum(0, np.minimum((size * EDIT_RATE).astype(np.int64), (size - Q) // Q))
        self.need = np.where(size >= Q, size - Q + 1 - Q * self.edits, np.iinfo(np.int64).max)
        self.reach = int((size + self.edits).max(initial=0))
        keys = [grams(x) if len(x) >= Q else np.zeros(0, np.uint64) for x in self.items]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        # By gram, then item, then place: an entry is one gram of one item, with all its places there.
        order = np.lexsort((place, owner, every))
        every, owner, self.place = every[order], owner[order], place[order]
        fresh = np.ones(len(every), bool)
        fresh[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        self.start = np.append(np.flatnonzero(fresh), len(every))
        self.item = owner[self.start[:-1]]
        self.keys, self.first, self.count = np.unique(every[self.start[:-1]], return_index=True, return_counts=True)
        bits = max(16, int(len(self.keys) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[self._spot(self.keys)] = True
        #: Items too short for a q-gram are looked for as they are.
        self.short = [(i, x) for i, x in enumerate(self.items) if 0 < len(x) < Q]

    def _spot(self, h: np.ndarray) -> np.ndarray:
        return (h * _BASE) >> self.shift

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, edits)`` in code points of ``text``; of overlapping places of one item the one with fewest edits."""
        codes, at = folded(text or "")
        found: list[tuple[int, int, int, int]] = []
        if len(codes) >= Q and len(self.keys):
            h = grams(codes)
            hit = np.flatnonzero(self.some[self._spot(h)])
            key = np.searchsorted(self.keys, h[hit])
            key[key == len(self.keys)] = 0
            true = self.keys[key] == h[hit]
            hit, key = hit[true], key[true]
            stretch = max(_STRETCH, self.reach)
            for begin in range(0, len(codes), stretch):
                a, z = np.searchsorted(hit, (begin, begin + stretch + self.reach))
                if a < z:
                    self._regions(codes, hit[a:z], key[a:z], found)
        for i, x in self.short:
            whole = "".join(map(chr, codes))
            word = "".join(map(chr, x))
            p = whole.find(word)
            while p >= 0:
                found.append((i, p, p + len(word), 0))
                p = whole.find(word, p + len(word))
        out: list[tuple[int, int, int, int]] = []
        for one in sorted(set(found)):
            if not out or out[-1][0] != one[0] or out[-1][2] <= one[1]:
                out.append(one)
            elif one[3] < out[-1][3]:
                out[-1] = one
        return [(i, int(at[s]), int(at[e - 1]) + 1, n) for i, s, e, n in sorted(out, key=lambda x: (x[1], x[0]))]

    def _regions(self, codes: np.ndarray, hit: np.ndarray, key: np.ndarray, found: list) -> None:
        """Occurrences among the grams of a text at places ``hit``, which are ``key`` of the index."""
        n = self.count[key]
        entry = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, item = np.repeat(hit, n), self.item[entry]
        order = np.argsort(item, kind="stable")
        at, entry, item = at[order], entry[order], item[order]
        own, begin, often = np.unique(item, return_index=True, return_counts=True)
        for i, a, c in zip(own.tolist(), begin.tolist(), often.tolist()):
            if c >= self.need[i]:
                self._bands(codes, i, at[a : a + c], entry[a : a + c], found)

    def _bands(self, codes: np.ndarray, i: int, at: np.ndarray, entry: np.ndarray, found: list) -> None:
        """Occurrences of item ``i``, whose grams ``entry`` a text has at ``at``.

        Counted is in how many places of the text a gram falls on a band. An edited occurrence has
        ``need`` such places. A gram that the item has often counts once for each band from its first
        to its last place, without its pairs being made: more bands may be retained, never fewer.
        """
        p, k, need = self.items[i], int(self.edits[i]), int(self.need[i])
        low, high = self.place[self.start[entry]], self.place[self.start[entry + 1] - 1]
        many = self.start[entry + 1] - self.start[entry]
        base = (int(at.min()) - len(p)) // (k + 1) - 1
        count = np.zeros((int(at.max()) // (k + 1)) - base + 4, np.int64)
        few = many <= _FEW
        c = many[few]
        pair = np.repeat(self.start[entry[few]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        diagonal = np.repeat(at[few], c) - self.place[pair]
        where = np.unique(np.repeat(at[few], c) * len(count) + diagonal // (k + 1) - base)
        count += np.bincount(where % len(count), minlength=len(count))
        step = np.zeros(len(count) + 1, np.int64)
        np.add.at(step, (at[~few] - high[~few]) // (k + 1) - base, 1)
        np.add.at(step, (at[~few] - low[~few]) // (k + 1) - base + 1, -1)
        count += np.cumsum(step)[:-1]
        # Diagonals to try whole: those of pairs, and of the first and last pairs of frequent grams.
        diagonal = np.sort(np.concatenate([diagonal, at[~few] - low[~few], at[~few] - high[~few]]))
        most = len(codes) - len(p)
        rest, whole = [], []
        for b in (np.flatnonzero(count[:-1] + count[1:] >= need) + base).tolist():
            first, last = b * (k + 1), (b + 2) * (k + 1)
            if last <= -k or first > most + k:
                continue
            values, often = np.unique(diagonal[np.searchsorted(diagonal, first) : np.searchsorted(diagonal, last)], return_counts=True)
            best = int(values[often.argmax()]) if len(values) else -1
            if 0 <= best <= most and np.array_equal(codes[best : best + len(p)], p):
                whole.append(best)
            else:
                rest.append((first, last))
        found += [(i, x, x + len(p), 0) for x in whole]
        # What surely overlaps an occurrence without edits would give way to it.
        starts = np.unique(np.array(whole, np.int64))
        for first, last in rest:
            x = np.searchsorted(starts, last + k - len(p))
            if x < len(starts) and starts[x] < first - 2 * k + len(p):
                continue
            was = alignment(p, codes, first, last, k)
            if was:
                found.append((i, *was))


_INDEXES: dict[int, Index] = {}


def _searcher(items: list[str | None]):
    key = hash(tuple(items))

    def run(text: pa.Array) -> pa.Array:
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index(items)
        index = _INDEXES[key]
        rows = [[dict(zip(("item", "start", "end", "edits"), x)) for x in index.find(t.as_py())] for t in text]
        return pa.array(rows, pa.list_(pa.struct([(c, pa.int32()) for c in ("item", "start", "end", "edits")])))

    return F.arrow_udf(run, LEAKS)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000):
    """The items in blocks of about ``block_chars`` characters, each as ``(ids, texts)``; distinct
    texts only, under the least id. Nulls and texts without a word can't leak and are left out."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike(r"\S")).groupBy("text").agg(F.min("id").alias("id"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("id", "text").collect()
        if rows:
            yield [r.id for r in rows], [r.text for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """``(id, item_id, start, end, edits)`` of each occurrence, in code points of the whole text.

    Null and empty texts have none; repeated rows each give theirs; without documents or items there
    are no rows. Items of equal text count as the one of least id. Other columns are not read.
    """
    kind = benchmark.schema[item_id_col].dataType
    own = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = own.select("id", F.lit(None).cast(kind).alias("item_id"), *[F.lit(0).alias(c) for c in ("start", "end", "edits")]).limit(0)
    for ids, texts in blocks(benchmark, item_id_col, item_text_col, block_chars):
        got = own.select("id", F.explode(_searcher(texts)("text")).alias("x"))
        names = F.lit([str(i) for i in ids]) if ids else F.array()
        out = out.unionByName(got.select("id", F.get(names, F.col("x.item")).cast(kind).alias("item_id"), "x.start", "x.end", "x.edits"))
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, unchanged, by one pass for each block of items."""
    for _, texts in blocks(benchmark, item_id_col, item_text_col, block_chars):
        docs = small_batches(docs).where(F.size(_searcher(texts)(F.col(f"`{text_col}`"))) == 0)
    return docs
