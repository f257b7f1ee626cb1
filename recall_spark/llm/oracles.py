"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from recall_spark.llm.quality import FENCE, MIN_WORDS, POINTS, SHARES, STEPS, TWO_SIDED, WEIGHT
from recall_spark.llm.urls import PATTERNS, SITE_RULES

_CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def _escaped(x: str) -> str:
    return rf"length(regexp_replace(replace({x}, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g'))"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({_escaped('role')} + {_escaped('text')} + 22)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def _urls() -> str:
    sites = sorted(SITE_RULES, key=lambda r: (len(r.pattern), r.verdict, r.name), reverse=True)

    def fits(name: str) -> str:
        host, _, path = name.partition("/")
        return f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r.name)} THEN '{r.name}'" for r in sites) + " END"
    said = "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in sites)
    own = sorted(PATTERNS, key=lambda r: (len(r.pattern), r.verdict, r.name), reverse=True)
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(low, '{r.regex()}') THEN '{r.name}'" for r in own) + " END"
    passed = ", ".join(f"'{r.name}'" for r in own if r.verdict == "allow")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r AS (SELECT *, {rule} AS rule, translate(host || path, '{upper}', '{lower}') AS low FROM p),
 m AS (SELECT *, CASE WHEN rule IS NULL THEN {pattern} END AS pattern FROM r)
SELECT page_id, host, path, rule, {said} WHEN pattern NOT IN ({passed}) THEN 'block' ELSE 'allow' END AS verdict, pattern FROM m"""


URLS = _urls()


def _ranked(sketch: str, keys: list[str], to: str) -> str:
    own = ", ".join([*keys, "k"])
    return f"""{to}0 AS (SELECT {own}, bucket, sum(n)::BIGINT AS n FROM {sketch} GROUP BY {own}, bucket),
 {to}1 AS (SELECT *, (sum(n) OVER (PARTITION BY {own} ORDER BY bucket))::BIGINT AS upto, (sum(n) OVER (PARTITION BY {own}))::BIGINT AS total FROM {to}0)"""


def _points(sketch: str, keys: list[str], to: str) -> str:
    below = lambda x: f"({2 * POINTS} * ({x}) // total + 1) // 2"
    return f"""{_ranked(sketch, keys, to)},
 {to} AS (SELECT {", ".join([*keys, "k"])}, bucket, {WEIGHT} * ({below("upto")} - {below("upto - n")}) AS n FROM {to}1)"""


def _fences(sketch: str, keys: list[str], to: str) -> str:
    own = ", ".join([*keys, "k"])
    two = ", ".join(f"'{x}'" for x in TWO_SIDED)
    return f"""{_ranked(sketch, keys, to)},
 {to}2 AS (SELECT {own}, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM {to}1 GROUP BY {own}),
 {to} AS (SELECT {own}, CASE WHEN k IN ({two}) THEN q1 - {FENCE} * greatest(q3 - q1, slack) ELSE -1 END AS low, q3 + {FENCE} * greatest(q3 - q1, slack) AS high FROM {to}2 JOIN slacks USING (k))"""


def _quality() -> str:
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    parts = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "n_letters"), "word_len": ("word_chars", "n_words")}
    shares = ", ".join(f"{{'k': '{k}', 'v': coalesce({a} * 1000 // nullif({b}, 0), 0)::BIGINT}}" for k, (a, b) in parts.items())
    slacks = ", ".join(f"('{k}', {v})" for k, v in SHARES.items())
    return rf"""WITH slacks(k, slack) AS (VALUES {slacks}),
 d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{word}')) AS w, generate_subscripts(regexp_extract_all(t, '{word}'), 1) AS i FROM d),
 tri AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS t FROM tri WHERE c IS NOT NULL),
 rep AS (SELECT doc_id, count(DISTINCT i + s)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) WHERE t GROUP BY doc_id),
 l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
 m AS (SELECT doc_id, lang, source, len(regexp_extract_all(t, '{word}'))::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')))::BIGINT AS n_letters FROM l LEFT JOIN rep USING (doc_id)),
 b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 sh AS (SELECT doc_id, lang, source, base_failed, u.k AS k, u.v AS v FROM (SELECT *, unnest([{shares}]) AS u FROM b)),
 sk AS (SELECT lang, source, k, v - v % (1::BIGINT << greatest(length(bin(v)) - {STEPS.bit_length()}, 0)) AS bucket, count(*) AS n FROM sh WHERE NOT base_failed GROUP BY ALL),
 {_points("sk", [], "ev")},
 skl AS (SELECT lang, k, bucket, n FROM sk UNION ALL SELECT lang, ev.k, ev.bucket, ev.n FROM (SELECT DISTINCT lang, k FROM sk) x JOIN ev ON ev.k = x.k),
 {_points("skl", ["lang"], "ln")},
 skg AS (SELECT lang, source, k, bucket, n FROM sk UNION ALL SELECT x.lang, x.source, ln.k, ln.bucket, ln.n FROM (SELECT DISTINCT lang, source, k FROM sk) x JOIN ln ON ln.k = x.k AND ln.lang IS NOT DISTINCT FROM x.lang),
 {_fences("skg", ["lang", "source"], "g")},
 f AS (SELECT sh.*, g.low, g.high FROM sh LEFT JOIN g ON g.k = sh.k AND g.lang IS NOT DISTINCT FROM sh.lang AND g.source IS NOT DISTINCT FROM sh.source),
 v AS (SELECT doc_id, bool_and(coalesce(v BETWEEN low AND high, true)) AS fine FROM f GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM b JOIN v USING (doc_id)"""


QUALITY = _quality()
