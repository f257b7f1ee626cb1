"""Byte-level BPE with given ranks, merged by a segment tree.

Each match of the pattern is encoded by itself. Its bytes are the leaves of a segment tree whose
nodes hold the least rank of an adjacent pair and, among equals, the leftmost place. A merge
removes the root's pair and updates two leaves (the merged part's pair and its left neighbour's),
each in logarithmic time, so a match of n bytes costs O(n log n) however long it is. Distinct
runs between white space are remembered by each Python worker, up to ``REMEMBERED`` of them.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import small_batches

REMEMBERED = 1 << 18
_NONE = 1 << 62
_BATCH = 1 << 18
#: Rows of an Arrow batch that are Python objects at one time.
_ROWS = 256
_RARE = re.compile(r"[^\S \n]")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: repeatedly joins the leftmost pair of least rank."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        raise ValueError(f"byte {piece!r} has no rank")
    get = ranks.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    # A leaf's value is rank * width + place, so the least value is the leftmost pair of least rank.
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the next part starts
    before = list(range(-1, n - 1))
    while tree[1] < _NONE:
        i = tree[1] & (width - 1)
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        r = get(piece[i : after[k]]) if k < n else None
        changed = [(i, _NONE if r is None else r * width + i)]
        if j < width:
            changed.append((j, _NONE))
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            changed.append((h, _NONE if r is None else r * width + h))
        for at, value in changed:
            at += width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary of ranks and one pattern.

    Matches of up to ``WIDE`` bytes are merged many at a time: one row of arrays holds one match's
    segment tree, and each round merges the root's pair of every row that still has one.
    """

    WIDE = 64

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for part, i in self.ranks.items():
            self.lengths[i] = len(part)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(k for k, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        get = self.ranks.get
        keys, ids = array("q"), array("q")
        for part, i in self.ranks.items():
            for at in range(1, len(part)):
                left, right = get(part[:at]), get(part[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pairs = np.append(np.array(keys, np.int64)[order], _NONE)
        self.joined = np.append(np.array(ids, np.int64)[order], 0)

    def _values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int, shift: int) -> np.ndarray:
        """Leaf values, rank and place, of pairs of ids; no rank gives ``_NONE``."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at] << shift | place, _NONE)

    def _merge_many(self, pieces: list[bytes], shift: int) -> list[bytes]:
        """Packed ids of ``pieces``, each of 2 to ``2 ** shift + 1`` bytes."""
        width, rows = 1 << shift, len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(rows, width + 1)
        ids = self.single[raw]
        if (ids[np.arange(width + 1) < size[:, None]] < 0).any():
            raise ValueError("a byte has no rank")
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width + 1), (rows, 1))
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        leaf = self._values(ids[:, :-1], ids[:, 1:], np.arange(width), shift)
        tree[:, width:] = np.where(np.arange(width) < size[:, None] - 1, leaf, _NONE)
        for level in range(shift - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + width
            tree[r, at] = value
            for _ in range(shift):
                at >>= 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            top = tree[row, 1]
            i = top & (width - 1)
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = top >> shift
            after[row, i] = k
            before[row, k] = i
            inner = j < width
            put(row[inner], j[inner], _NONE)
            some = k < size[row]
            value = np.full(len(row), _NONE, np.int64)
            r, a, b = row[some], i[some], k[some]
            value[some] = self._values(ids[r, a], ids[r, b], a, shift)
            put(row, i, value)
            h = before[row, i]
            r, a, b = row[h >= 0], h[h >= 0], i[h >= 0]
            put(r, a, self._values(ids[r, a], ids[r, b], a, shift))
            row = row[tree[row, 1] < _NONE]
        out = []
        for own, nxt, n in zip(ids.astype("<u4"), after.tolist(), size.tolist()):
            at, parts = 0, []
            while at < n:
                parts.append(at)
                at = nxt[at]
            out.append(own[parts].tobytes())
        return out

    def _merged(self, matches: set[str]) -> dict[str, bytes]:
        """Packed ids of each match."""
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            raw = m.encode("utf-8")
            i = self.ranks.get(raw)
            if i is not None:
                out[m] = i.to_bytes(4, "little")
            elif len(raw) > self.WIDE:
                out[m] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 2).bit_length() if len(raw) > 2 else 0, []).append((m, raw))
        for shift, own in groups.items():
            out.update(zip((m for m, _ in own), self._merge_many([r for _, r in own], shift)))
        return out

    def _pieces(self, text: str) -> list[str]:
        """``text`` cut before every space and newline, or else whole.

        No match of the pattern has white space after another character, so a cut before white
        space that follows none leaves every match as it is. Texts where white space meets white
        space, or that hold rarer kinds of it, aren't cut.
        """
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text):
            return [text]
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[x if x[:1] == "\n" else f" {x}" for x in rest]]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        found = {x: self.pattern.findall(x) for x in pieces}
        ids = self._merged({m for ms in found.values() for m in ms})
        return {x: b"".join([ids[m] for m in ms]) for x, ms in found.items()}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= _BATCH):
                chars += len(texts[to])
                to += 1
            cut = [self._pieces(x) for x in texts[at:to]]
            ids = [list(map(self.known.get, x)) for x in cut]
            new = {p for x, own in zip(cut, ids) if None in own for p, i in zip(x, own) if i is None}
            if new:
                fresh = self._learn(new)
                short = {k: v for k, v in fresh.items() if len(k) <= self.WIDE}
                if len(self.known) + len(short) > REMEMBERED:
                    self.known.clear()
                self.known.update(short)
                for x, own in zip(cut, ids):
                    if None in own:
                        own[:] = [fresh[p] if i is None else i for p, i in zip(x, own)]
            out += [b"".join(own) for own in ids]
            at = to
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        n = self.lengths[at]
        shift = self.starts[at] - (np.cumsum(n) - n)
        place = np.repeat(shift, n)
        place += np.arange(len(place))
        return self.blob[place].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for a vocabulary file that every machine has at ``path``."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, pattern] = Codec(f.read(), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` of every row: packed ids of the whole text; null counts as empty."""

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array(own.encode_many([x.as_py() or "" for x in text]), pa.binary())

    return small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), run(F.col(f"`{text_col}`")).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded(id, ids)`` with ``decoded``, the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(x.as_py() or b"") for x in ids], pa.binary())

    return small_batches(encoded).select("id", "ids", run("ids").alias("decoded"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` by one Python pass; the text is encoded once and the ids are decoded.

    Every row gives one row, repeated or not; null and empty texts give no ids and no bytes; other
    columns are not read; an empty table gives an empty result.
    """

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def run(text: pa.Array) -> pa.Array:
        own, parts = codec(path, pattern), []
        for at in range(0, len(text), _ROWS):
            ids = own.encode_many([x or "" for x in text.slice(at, _ROWS).to_pylist()])
            decoded = [own.decode(x) for x in ids]
            parts.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["ids", "decoded"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.binary()), ("decoded", pa.binary())]))

    return small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), run(F.col(f"`{text_col}`")).alias("r")).select("id", "r.*")
