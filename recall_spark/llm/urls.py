"""URL rules indexed by their rarest literal token.

A rule is a glob: ``||`` binds to the start of the host or of a label in it, ``^`` is a separator or
the end, ``*`` is anything. A literal run of letters and digits that is bounded on both sides in the
pattern must be a whole token of every url the rule fits. Each rule is filed under the one of its
tokens that is rarest in the urls at hand; a url's tokens fetch the rules filed under them, and only
those run their regular expressions. Rules without such a token are run on every url.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    pattern: str
    verdict: str
    #: Rules of the highest tier win, then the longest.
    tier: int = 0

    def regex(self) -> str:
        out = []
        for part in re.findall(r"\|\||\^|\*|[^|^*]+|\|", self.pattern):
            out.append({"||": r"^(?:[^/]*\.)?", "^": "(?:[^a-z0-9]|^|$)", "*": ".*"}.get(part) or re.escape(part))
        return "(?s)" + "".join(out)

    def tokens(self) -> list[str]:
        """Literal tokens that are bounded on both sides."""
        found = re.finditer(r"[a-z0-9]+", self.pattern)
        bounded = [m.group() for m in found if m.start() and m.end() < len(self.pattern) and "*" not in (self.pattern[m.start() - 1], self.pattern[m.end()])]
        return sorted(set(bounded))


def site_rule(name: str, verdict: str) -> Rule:
    """A rule ``host/path`` for a host, all its subdomains and every path that starts with ``/path``."""
    return Rule(name, f"||{name}", verdict, tier=1)


SITE_RULES = [
    site_rule("org/", "allow"),
    site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"),
    site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
]
#: Words that block wherever they stand as a token.
_WORDS = "casino porn xxx warez viagra adult spam ads poker betting escort keygen torrent jackpot roulette cialis nude webcam hentai crackz".split()
#: Words that block next to each other, each first one with each second one.
_FIRST = "free cheap best buy win online fast easy instant discount".split()
_SECOND = "bets pills loans followers meds slots spins replica likes betting crypto lottery diploma backlinks coupons".split()
#: Words that block with anything between them, in this order.
_OPEN, _CLOSE = "click track redirect banner popup affiliate".split(), "out go ref campaign exit sponsor".split()
#: Hosts whose label blocks, whatever follows.
_HOSTS = "adserver adtrack doubleads popads trackers spamfarm clickfarm linkfarm".split()
#: Longer patterns that let pass what a shorter one would block.
_PASS = ["adult^education", "adult^learning", "adult^literacy", "spam^filter", "spam^report", "casino^royale", "xxx^olympiad", "free^loans^library", "ads^txt", "track^*^package^*^out"]


def _own_rules() -> list[Rule]:
    """The method's own rules for what no site rule decides."""
    block = [f"^{w}^" for w in _WORDS]
    block += [f"^{a}^{b}^" for a in _FIRST for b in _SECOND]
    block += [f"^{a}^*^{b}^" for a in _OPEN for b in _CLOSE]
    block += [f"||{h}^" for h in _HOSTS] + [f"||*.{h}.*^" for h in _HOSTS]
    return [Rule(p, p, "block") for p in block] + [Rule(f"^{p}^", f"^{p}^", "allow") for p in _PASS]


PATTERNS = _own_rules()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """``url``, ``host`` and ``path``; both empty where the url is null or has no ``://``."""
    host = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return urls.select("url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def _rules_table(spark, rows: list[dict]) -> DataFrame:
    kind = "array<struct<token:string,name:string,regex:string,verdict:string,tier:int,size:int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def filed(rules: list[Rule], seen: dict[str, int]) -> list[dict]:
    """The rules, each under the one of its tokens that fewest urls have; "" where it has none."""
    return [{"token": min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default=""), "name": r.name, "regex": r.regex(), "verdict": r.verdict, "tier": r.tier, "size": len(r.pattern)} for r in rules]


def candidates(own: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rules that each of ``own(url, host, path)`` must run: those filed under its tokens, or under none."""
    placed = own.withColumn("at", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all(F.translate("at", _UPPER, _LOWER), F.lit("([a-z0-9]+)"), 1))
    keyed = placed.select("url", "at", F.explode(F.concat(tokens, F.array(F.lit("")))).alias("token"))
    wanted = sorted({t for r in rules for t in r.tokens()})
    seen = {r.token: r.n for r in keyed.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if wanted else {}
    return keyed.join(_rules_table(own.sparkSession, filed(rules, seen)), "token")


def judge(urls: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """``(url, host, path, rule, pattern, verdict)`` for each distinct url of ``urls(url)``.

    ``rule`` names the site rule that decided, ``pattern`` the method's own rule that did; both are
    null where nothing fits. A null url is a row like any other; no url gives no rows.
    """
    rules = SITE_RULES + PATTERNS if rules is None else rules
    own = parts(urls.select("url").distinct())
    target = F.when(F.col("tier") == 1, F.col("at")).otherwise(F.translate("at", _UPPER, _LOWER))
    fits = candidates(own, rules).where(F.rlike(target, F.col("regex")))
    best = fits.groupBy("url").agg(F.max(F.struct("tier", "size", "verdict", "name")).alias("best"))
    out = own.join(best.withColumnRenamed("url", "_u"), F.col("url").eqNullSafe(F.col("_u")), "left")
    named = lambda tier: F.when(F.col("best.tier") == tier, F.col("best.name"))
    return out.select("url", "host", "path", named(1).alias("rule"), named(0).alias("pattern"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filtered(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, pattern, verdict)`` for every row of ``pages``; each distinct url is judged once.

    Repeated pages each keep their row; ids may be null; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    verdict = judge(rows, rules).withColumnRenamed("url", "_u")
    return rows.join(verdict, F.col("url").eqNullSafe(F.col("_u"))).drop("_u", "url")
