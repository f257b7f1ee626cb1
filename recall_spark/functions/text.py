"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OID = "6ba7b8129dad11d180b400c04fd430c8"
#: Code points that cleaned text doesn't keep.
DROPPED = r"[\p{Cc}&&[^\n\r\t]]|[\x{FE00}-\x{FE1F}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2702}-\x{27B0}\x{2600}-\x{26FF}\x{1F100}-\x{1F1FF}]"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
_SPLIT = re.compile(r"[\W_]+")


def tokens(content: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more, in order."""
    words = F.split(F.trim(F.lower(F.regexp_replace(content, r"[^\p{L}\p{N}]+", " "))), " ")
    return F.filter(words, lambda w: F.octet_length(w) >= 2)


def query_tokens(query: str) -> list[str]:
    """``tokens`` of a literal, on the driver."""
    return [w for w in _SPLIT.split(query.lower()) if len(w.encode("utf-8")) >= 2]


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points without regard to case; beside an empty text, the other's bytes."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == "", F.octet_length(y)).when(y == "", F.octet_length(x)).otherwise(F.levenshtein(x, y))


def strip_html(text: Column) -> Column:
    """Text between tags, without the contents of script, style and head."""
    bare = F.regexp_replace(text, r"(?is)<(script|style|head)\b[^>]*(?<!/)>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[/!?a-zA-Z][^>]*>", " ")
    for entity, sign in _ENTITIES.items():
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return bare


def keep_printable(text: Column) -> Column:
    return F.regexp_replace(text, DROPPED, "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """HTML stripped, unprintable code points dropped, white space collapsed."""
    return collapse_spaces(keep_printable(strip_html(text)))


def content_hash(content: Column) -> Column:
    """UUID version 5 of the content under the OID name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(_OID)), F.encode(content, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def valid_content(content: Column, most: int = 64 * 1024) -> Column:
    """Neither blank nor over ``most`` bytes; null isn't valid."""
    return F.coalesce((F.octet_length(content) <= most) & content.rlike(r"(?U)\S"), F.lit(False))


def truncated(text: Column, n: int = 50) -> Column:
    """The first ``n`` code points and ``...``, where a text has more bytes than ``n``."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def chunks(text: Column, most: int) -> Column:
    """Sentences packed greedily into chunks of at most ``most`` words; a longer sentence is a chunk."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = words(s)
        fits = (acc["n"] + n <= most) | (acc["n"] == 0)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(acc["n"] == 0, s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"), (acc["n"] + n).alias("n"))).otherwise(
            F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), s.alias("now"), n.alias("n"))
        )

    return F.aggregate(sentences(text), start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))


def expanded_query(query: str, n_tokens: int, repeat: int = 2) -> str:
    """What is embedded for a query: short ones get a lead, and all are repeated."""
    lead = f"search for information about {query}" if n_tokens <= 3 else query
    return " ".join([lead] * max(1, repeat))
