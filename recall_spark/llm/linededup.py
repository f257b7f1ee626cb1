"""Removal of passages that repeat anywhere in the corpus, by content-defined chunks of lines.

Lines. A line ends at a newline. So that a passage is found wherever it begins and however it was
wrapped, lines are also wrapped after each word of ``LONG`` characters or more: the wrap depends on
that word alone, so inside a shared passage all copies have the same lines.

Chunks. A rolling hash over every two line hashes in a row is taken; a chunk ends where it has a local
minimum, so a boundary depends on four lines only and an insertion moves none but its neighbours. A
chunk has two lines or more, three on average.

Repeats. Chunks are counted by hash over all documents. Only those that may repeat travel with their
lines, and are grouped by the lines themselves, byte for byte; all but the first (least id, then text,
then place) go. A passage that begins or ends inside a chunk is followed line by line into the chunks
beside it, unless these repeat themselves, as far as its lines are those of the first copy. What goes is a run of lines of
``MIN_CHARS`` characters or more, the white space after a line counting as one; shorter runs are phrases of the language and stay.

Which chunks may repeat is told by one bit of their hash in a bitmap of fixed size, so a chunk that
doesn't repeat rarely travels. The bitmap changes what is shuffled, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions.binding import let
from recall_spark.llm.common import may_hold, settled, text_hash, written

#: Characters of a word that ends a line.
LONG = 7
#: Short words, then a word or none (group 1), and the white space after it. Chinese and Japanese text
#: has a word up to its marks. Possessive, so matching is linear and takes every character.
LINE = rf"((?:\S{{1,{LONG - 1}}}+[ \t\x0B\f\r]++(?=\S))*+(?:[\x21-\u2FFF]++|[^\s\x21-\u2FFF][^\s\u3001\u3002\uFF01-\uFF1F]*+[\u3001\u3002\uFF01-\uFF1F]*+)?+)\s*+"
MIN_CHARS = 120


def lines(text: Column, group: int = 0) -> Column:
    """All of ``text`` in order, cut into lines, with the white space after them or (group 1) without.
    The last is empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(group))


def _step(value: Column, name: str) -> Column:
    """``value`` as a generator of one row: a plain projection could be inlined into the next one's
    lambdas, or into a filter of the caller's, and then be evaluated once for each line."""
    return F.explode(F.array(value)).alias(name)


def _part(of: str, a: Column, n: Column) -> Column:
    """``n`` elements of an array from number ``a`` on. ``slice`` copies the whole array each time."""
    return F.transform(F.sequence(a, a + n - 1), lambda i: F.get(of, i))


def chunked(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(chunks, ends)`` of a text: each chunk's lines joined by newlines, which no line holds, and
    for each line whether a chunk ends with it."""

    def ends(r: Column) -> Column:
        return F.transform(r, lambda x, i: (i > 0) & (i < F.size(r) - 2) & (x < F.get(r, i - 1)) & (x <= F.get(r, i + 1)))

    def cut_at(own: Column, e: Column) -> Column:
        marked = F.transform(own, lambda x, i: F.when(F.get(e, i), F.concat(x, F.lit("\n"))).otherwise(x))
        return let(F.split(F.array_join(marked, "\n"), "\n\n", -1), lambda c: body(c, e))

    def rolled(own: Column) -> Column:
        hashes = F.transform(own, lambda x: F.xxhash64(x))
        return let(let(let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))), ends), lambda e: cut_at(own, e))

    return let(let(lines(text, 1), lambda x: F.slice(x, 1, F.size(x) - 1)), rolled)


def _equal_lines(x: Column, y: Column, back: bool = False) -> Column:
    """How many leading lines (or, ``back``, last ones) of two chunks are equal; an empty chunk has none."""
    x, y = (F.reverse(F.split(c, "\n")) if back else F.split(c, "\n") for c in (F.nullif(x, F.lit("")), F.nullif(y, F.lit(""))))
    n = F.least(F.size(x), F.size(y))
    differ = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a == b), False)
    return F.when(x.isNull() | y.isNull(), 0).when(differ > 0, differ - 1).otherwise(n).cast("int")


def _key(i: str, m: str, j: str) -> Column:
    return F.xxhash64(i, m, j)


def _edges(later: DataFrame, alone: DataFrame, met: DataFrame) -> DataFrame:
    """``(id, mark, side, at, own, other)``: for each chunk of ``later`` and each side of it, the chunk
    beside it, if that repeats nowhere, and the one beside the first copy.

    Either is at hand or, where it has travelled, looked up by its place: among ``alone``, travelled
    chunks that repeat nowhere, or in ``met``.
    """
    alone = written(alone.groupBy(F.col("id").alias("_i"), F.col("mark").alias("_m"), F.col("j").alias("_j")).agg(F.min("own").alias("found")))
    held = may_hold(alone.select(_key("_i", "_m", "_j").alias("hash")))
    sides = []
    for side, at, step in (("before", "a", -1), ("after", "z", 1)):
        first = [F.col("first.id").alias("i"), F.col("first.mark").alias("m"), (F.col("first.j") + step).alias("n"), F.col(f"first.{side}").alias("other")]
        sides.append(later.select("id", "mark", (F.col("j") + step).alias("j"), F.lit(side).alias("side"), F.col(at).alias("at"), F.col(side).alias("own"), *first))
    both = sides[0].unionByName(sides[1])
    place = lambda i, m, j: F.col(i).eqNullSafe(F.col("_i")) & (F.col(m) == F.col("_m")) & (F.col(j) == F.col("_j"))
    columns = ["id", "mark", "side", "at", "own", "i", "m", "n", "other"]
    looked = both.where(F.col("own").isNull() & held(_key("id", "mark", "j"))).drop("own").join(alone, place("id", "mark", "j")).withColumnRenamed("found", "own")
    own = written(both.where("own is not null").select(*columns).unionByName(looked.select(*columns)))
    wanted = own.where("other is null").select(_key("i", "m", "n").alias("hash")).distinct()
    there = met.where(may_hold(wanted)(_key("id", "mark", "j"))).groupBy(F.col("id").alias("_i"), F.col("mark").alias("_m"), F.col("j").alias("_j")).agg(F.min("own").alias("found"))
    looked = own.where("other is null").drop("other").join(written(there), place("i", "m", "n")).withColumnRenamed("found", "other")
    columns = ["id", "mark", "side", "at", "own", "other"]
    return own.where("other is not null").select(*columns).unionByName(looked.select(*columns))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, a, z, chars)``: lines ``a`` to before ``z``, of so many characters, are lines in a
    row that an earlier place has.

    Places are ordered by id, text and number. A chunk that goes has an equal one at an earlier place,
    so the first of equal chunks always stays.
    """
    text = F.col(f"`{text_col}`")
    several = lambda c: F.contains(c, F.lit("\n"))
    after = lambda ends: F.filter(F.transform(ends, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    both = chunked(text, lambda chunks, ends: F.struct(chunks.alias("chunks"), F.concat(F.array(F.lit(0)), after(ends)).alias("starts")))
    # Read twice: texts are cut once.
    found = written(docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text).alias("mark"), F.explode(F.array(both)).alias("c")).select("id", "mark", "c.*"))
    hashes = found.select(F.explode("chunks").alias("c")).where(several(F.col("c"))).select(F.xxhash64("c").alias("hash"))
    held = may_hold(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    travels = lambda c: several(c) & held(F.xxhash64(c))
    beside = lambda j: F.coalesce(F.get("chunks", j), F.lit(""))
    wide = F.transform("chunks", lambda c, j: F.struct(j.alias("j"), F.get("starts", j).alias("a"), c.alias("own"), beside(j - 1).alias("before"), beside(j + 1).alias("after")))
    each = found.select("id", "mark", F.explode(wide).alias("x")).where(several(F.col("x.own"))).select("id", "mark", "x.*")
    # A chunk beside one that travels goes along only if it doesn't travel itself.
    met = written(each.where(travels(F.col("own"))).select("id", "mark", "j", "a", "own", *[F.when(~travels(F.col(c)), F.col(c)).alias(c) for c in ("before", "after")]))
    first = met.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "mark", "j", "before", "after")).alias("first"))
    # Written, so that both sides of the join come straight from a shuffle and a hot chunk can be split.
    first = written(first.where("n > 1").select("own", "first"))
    there = F.col("first.mark").isNotNull()
    rest = F.when(~there, F.col("own")).alias("own")
    matched = written(met.join(first, "own", "left").select("id", "mark", "j", "a", (F.col("a") + F.size(F.split("own", "\n"))).alias("z"), (F.length("own") + 1).alias("chars"), rest, "before", "after", "first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("j") == F.col("first.j"))
    later = matched.where(there & ~same)
    edges = _edges(later, matched.where(~there).select("id", "mark", "j", "own"), met)
    back = F.col("side") == "before"
    n = F.when(back, _equal_lines(F.col("own"), F.col("other"), True)).otherwise(_equal_lines(F.col("own"), F.col("other")))
    more = edges.select("id", "mark", "at", back.alias("back"), n.alias("n"), F.split("own", "\n").alias("own")).where("n > 0")
    part = F.when(F.col("back"), F.slice("own", -F.col("n"), F.col("n"))).otherwise(F.slice("own", 1, F.col("n")))
    chars = F.aggregate(part, F.lit(0), lambda t, x: t + F.length(x) + 1)
    more = more.select("id", "mark", F.when(F.col("back"), F.col("at") - F.col("n")).otherwise(F.col("at")).alias("a"), F.when(F.col("back"), F.col("at")).otherwise(F.col("at") + F.col("n")).alias("z"), chars.alias("chars"))
    return later.select("id", "mark", "a", "z", "chars").unionByName(more)


def _longest(ranges: Column) -> Column:
    """Characters of the longest run of ranges in order of which each begins where one before ends, or earlier."""

    def step(acc: Column, x: Column) -> Column:
        chars = F.when(x["a"] <= acc["z"], acc["chars"]).otherwise(0) + x["chars"]
        return F.struct(F.greatest(acc["z"], x["z"]).alias("z"), chars.alias("chars"), F.greatest(acc["most"], chars).alias("most"))

    return F.aggregate(ranges, F.struct(F.lit(-1).alias("z"), F.lit(0).alias("chars"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, text, n_removed)``: every row of ``docs`` as a struct, its text without the repeats, and
    how many of its lines went.

    The rest of a text is unchanged, byte for byte. A null text stays null. Rows of one id
    and text are one document: they don't remove each other. Null ids come first.
    An empty table gives an empty result.
    """

    def ranges() -> DataFrame:
        gone = repeats(docs, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.array_sort(F.collect_set(F.struct("a", "z", "chars"))).alias("gone"))
        return gone.where(_longest(F.col("gone")) >= min_chars)

    gone = settled(docs.sparkSession, ranges, written)
    # The caller's columns go along one by one; a struct's fields can be lost in a row of generators.
    own = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in own.items()], F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), text_hash(F.col(f"`{text_col}`")).alias("mark"))
    # Only texts that may lose something are shuffled.
    touched = may_hold(gone.select(F.xxhash64("_id", "_mark").alias("hash")))(F.xxhash64("id", "mark"))
    met = rows.where(touched).join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select(*own, "text", "gone")
    split = met.select(*own, "text", "gone", _step(F.when(F.col("gone").isNotNull(), lines(F.col("text"))), "lines"))
    at = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda x: F.sequence(x["a"], x["z"] - 1)))))
    split = split.select(*own, "text", "lines", _step(at, "at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    size = lambda s, e: F.aggregate(_part("lines", s, e - s + 1), F.lit(0), lambda n, x: n + F.length(F.rtrim(x, F.lit(" \t\n\x0b\f\r"))) + 1)
    runs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"), size(s, e).alias("chars"))), lambda r: r["chars"] >= min_chars)
    split = split.select(*own, "text", "lines", _step(F.flatten(F.transform(runs, lambda r: F.sequence(r["s"], r["e"]))), "out"))
    kept = split.select(*own, "text", "lines", "out", _step(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "out"), "kept"))
    whole = F.col("out").isNull() | (F.size("out") == 0)
    rest = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "")
    done = kept.select(*own, F.inline(F.array(F.struct(F.when(whole, F.col("text")).otherwise(rest).alias("text"), F.when(whole, 0).otherwise(F.size("out")).alias("n_removed")))))
    every = done.unionByName(rows.where(~touched).select(*own, "text", F.lit(0).alias("n_removed")))
    return every.select(F.struct(*[F.col(k).alias(c) for k, c in own.items()]).alias("row"), "text", "n_removed")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """``docs`` with texts freed of repeats. Documents that lost lines and have fewer than ``min_words``
    words left are dropped; whatever is left of the others stays.

    A column ``n_chars`` follows the text.
    """
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(\S*[\p{L}\p{N}]\S*)"), F.lit(1)))
    done = deduplicated(docs, id_col, text_col).where((F.col("n_removed") == 0) | (words >= min_words))
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
