"""Personal data: base patterns and seeds, and contexts bootstrapped from them.

Base spans come from four regular expressions and are seeds of their kinds. Seeds of a fifth kind,
``secret``, are long hexadecimal keys; by themselves these are no spans. The words and marks before
and after a seed are lexical patterns, one-sided and two-sided; identifiers (runs of letters, digits
and ``._%+@-`` with a digit or an ``@``) in the same contexts are the patterns' other instances. Scores
travel over the graph of patterns and distinct instances: a pattern's confidence in a kind is the
smoothed mean of its instances' scores, an instance's score is one minus the chance that all its
trusted patterns err, and seeds keep score one. After ``ROUNDS`` rounds the patterns of enough support
and confidence mark the identifiers that stand in them anywhere.

The regular expressions are the plain ones rewritten so that a failing start isn't tried again at
each later character of the same run: they match the same places in linear time. Places are sums of
what lies before them, taken in blocks, and contexts are read off the gaps between matches, so a text
of many matches takes time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions.binding import let
from recall_spark.llm.common import cut, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only contexts find.
MORE_KINDS = ("secret",)
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.8
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of 14 to 19 digits; no other run can pass.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IDENTIFIER = rf"(?<![{_LOCAL}@])(?=[A-Za-z._%+-]*+[0-9@])[{_LOCAL}@]{{6,}}+"
#: A seed of kind ``secret``.
SECRET = r"(?i)^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
_SIGN = {"email": "@", "ip": ".", "phone": "+"}
_BLOCK = 256
#: What stands for a base span when identifiers are looked for: neither a word nor part of one.
_MASK = "\u00b7"
_FOUND = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _sums(sizes: Column) -> Column:
    """For each element of an array of integers, the sum of those before it."""

    def each(s: Column) -> Column:
        n = F.size(s)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
        inside = lambda b: F.sequence(b * _BLOCK, F.least((b + 1) * _BLOCK, n) - 1)
        run = lambda values, start: F.aggregate(values, F.struct(start.alias("at"), _none("array<int>").alias("all")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
        totals = F.transform(blocks, lambda b: F.aggregate(inside(b), F.lit(0), lambda t, i: t + F.get(s, i)))
        first = let(run(totals, F.lit(0)), lambda o: F.flatten(F.transform(blocks, lambda b: run(F.transform(inside(b), lambda i: F.get(s, i)), F.get(o, b)))))
        return F.when(n > 0, first).otherwise(_none("array<int>"))

    return let(sizes, each)


def _tokens(part: Column) -> Column:
    """Words and single marks, lower-cased."""
    return F.regexp_extract_all(F.lower(part), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1))


def _patterns(before: Column, after: Column) -> Column:
    """Contexts of what stands between two stretches of text: the last one to three tokens before it,
    and one or two of them with the first token after it."""

    def named(left: Column, right: Column) -> Column:
        n = F.size(left)
        word = lambda k: F.get(left, n - k)
        one, two = word(1), F.concat(word(2), F.lit(" "), word(1))
        sided = lambda p: F.concat(p, F.lit(" _ "), F.get(right, F.lit(0)))
        return F.filter(F.array(one, two, F.concat(word(3), F.lit(" "), two), sided(one), sided(two)), lambda p: p.isNotNull())

    return let(_tokens(F.substring_index(before, " ", -4)), lambda left: let(_tokens(F.substring_index(after, " ", 2)), lambda right: named(left, right)))


def _split(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(gaps, values)``: the matches in a text and what lies between them, before and after."""
    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda v: let(F.split(text, pattern, -1), lambda g: body(g, v)))


def _places(text: Column, pattern: str) -> Column:
    """All matches, in code points, with the contexts that they stand in."""

    def found(g: Column, v: Column) -> Column:
        sizes = F.transform(v, lambda x, i: F.length(F.get(g, i)) + F.length(x))

        def place(x: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(g, i))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"), _patterns(F.get(g, i), F.coalesce(F.get(g, i + 1), F.lit(""))).alias("patterns"))

        return let(_sums(sizes), lambda at: F.transform(v, lambda x, i: place(x, i, at)))

    return _split(text, pattern, found)


def _masked(text: Column, kind: str) -> Column:
    """``text`` with each span of a base kind blotted out."""
    blot = lambda x: F.when(_PASSES[kind](x), F.repeat(F.lit(_MASK), F.length(x))).otherwise(x)
    whole = lambda g, v: F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(blot(F.get(v, i)), F.lit("")))), "")
    return F.when(_signed(text, kind), _split(text, BASE[kind], whole)).otherwise(text)


def _signed(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(_SIGN[kind])) if kind in _SIGN else text.rlike("[0-9]")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def weight(i: Column) -> Column:
        v = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + weight(i)) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


_PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\.", -1), _octet),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _base(text: Column) -> Column:
    """``array<struct<start,kind,end,value,patterns>>`` of the base kinds, by start, then kind's number."""
    out = []
    for no, kind in enumerate(KINDS):
        found = F.filter(_places(text, BASE[kind]), lambda x: _PASSES[kind](x["value"]))  # noqa: B023
        found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["patterns"].alias("patterns")))  # noqa: B023
        out.append(F.when(_signed(text, kind), found).otherwise(_none("array<struct<start:int,kind:int,end:int,value:string,patterns:array<string>>>")))
    return F.array_sort(F.concat(*out))


def _step(value: Column, name: str) -> Column:
    return F.explode(F.array(value)).alias(name)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, base, others)``: base spans and other identifiers of every row, each with the
    patterns it stands in. ``mark`` hashes the text, to tell rows of one id apart."""
    text = F.col("text")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.select("id", "text", F.xxhash64("text").alias("mark"), _step(_base(text), "base"))
    # Without a digit or an @ there is nothing to blot out and no identifier.
    own = own.select("id", "mark", "base", _step(F.when(text.rlike("[0-9@]"), text), "text"))
    for kind in KINDS:
        own = own.select("id", "mark", "base", _step(_masked(text, kind), "text"))
    others = F.coalesce(F.when(text.isNotNull(), _places(text, IDENTIFIER)), _none(_FOUND))
    return own.select("id", "mark", "base", _step(others, "others"))


def trusted(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(pattern, kind, score)`` of the patterns to believe, from the graph of ``mentions``.

    Copies count once: an edge is a distinct pair of pattern and instance. Sums are pre-aggregated;
    no pattern's instances are ever collected.
    """
    seeds = found.select(F.explode("base").alias("m")).select("m.value", "m.kind", F.explode("m.patterns").alias("pattern"))
    kind = F.when(F.col("m.value").rlike(SECRET), len(KINDS)).otherwise(-1)
    other = found.select(F.explode("others").alias("m")).select("m.value", kind.alias("kind"), F.explode("m.patterns").alias("pattern"))
    edges = cut(seeds.unionByName(other).distinct())
    seeded = edges.where("kind >= 0").select(F.col("value"), F.col("kind").alias("k"), F.lit(1.0).alias("s")).distinct()
    sizes = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.select("pattern", "value").distinct()
    scored = seeded
    patterns = None
    for _ in range(rounds):
        mass = pairs.join(scored, "value").groupBy("pattern", "k").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("known"))
        patterns = cut(mass.join(sizes, "pattern").select("pattern", "k", (F.col("s") / (F.col("n") + 1)).alias("p"), "known").where((F.col("known") >= support) & (F.col("p") >= confidence)))
        new = pairs.join(patterns, "pattern").groupBy("value", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("s"))
        scored = cut(seeded.unionByName(new).groupBy("value", "k").agg(F.max("s").alias("s")))
    return patterns.groupBy("pattern").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("k")).alias("k"))).alias("b")).select("pattern", (-F.col("b.k")).alias("kind"), F.col("b.p").alias("score"))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(id, base, added)`` for every row of ``docs``.

    ``base`` and ``added`` are ``array<struct<start,kind,end>>`` in code points, sorted; ``kind`` is
    its number in ``KINDS``, then ``MORE_KINDS``. A null or empty text has none; repeated rows each have a result; other
    columns are not read; an empty table gives an empty result.
    """
    found = written(mentions(docs, id_col, text_col))
    patterns = trusted(found, rounds, support, confidence)
    marked = found.select("id", "mark", F.explode("others").alias("m")).select("id", "mark", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    extra = marked.join(patterns, "pattern").groupBy("id", "mark", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    extra = extra.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end"))).alias("added"))
    out = found.join(extra, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return out.select("id", slim.alias("base"), F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS + MORE_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
