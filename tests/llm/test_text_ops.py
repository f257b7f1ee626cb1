"""Operators on single texts against plain Python on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from recall_spark.llm import bpe, chat, langid, linededup, pii, quality, queries, urls

PATH = public_tokenizers.path(queries.TOKENIZER)
ODD = [None, "", " ", "\n\n", "a", "Ünï ©ode 😀", "x" * 5000, "word " * 3000, "a\x1cb\x85c d e", "A b\tc\nd"]


def documents(spark, texts, **extra):
    """Rows with repeated ids' texts, a null in each column, and columns whose names clash."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", 0, "x", True, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kept boolean, hash bigint")


# -- Quality.
def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_measures(spark):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a ", "b ", "c ", "\n", "#", "é", "\x0b", "\x1c", "B"]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    got = {x.id: x for x in quality.verdicts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        want = plain_measures(t)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, t
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    clean = [" ".join(word() for _ in range(r.randint(60, 300))) for _ in range(150)]
    noisy = [" ".join(word() + "###" for _ in range(80)), " ".join(word().upper() for _ in range(80)), " | ".join(word() for _ in range(80)), "\n".join([" ".join(word() for _ in range(5))] * 3 + [" ".join(word() for _ in range(60))] * 1)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + noisy)], "doc_id bigint, text string, lang string, source string")
    kept = {x.id for x in quality.verdicts(docs).where("kept").collect()}
    assert kept >= set(range(150)) and not kept & {150, 151, 152, 153}
    rows = quality.kept_rows(docs.withColumn("_m", F.lit(1)).withColumn("fences", F.lit("f")))
    assert rows.columns == [*docs.columns, "_m", "fences"] and {x.doc_id for x in rows.collect()} == kept


def test_quality_small_groups_borrow_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, long + f" z{i}", "en", f"s{i}") for i in range(120)] + [(200, " ".join(f"w{i}#####" for i in range(80)), "en", "lonely")], "doc_id bigint, text string, lang string, source string")
    got = {x.id: x.kept for x in quality.verdicts(docs).collect()}
    assert not got[200] and all(got[i] for i in range(120))
    assert quality.verdicts(docs.limit(0)).count() == 0 and quality.kept_rows(docs.limit(0)).count() == 0


def test_quality_buckets(spark):
    values = [0, 1, 31, 63, 64, 65, 100, 127, 128, 1000, 10**6, 2**40 + 12345]
    got = [x.b for x in spark.createDataFrame([(v,) for v in values], "v bigint").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert all(b <= v and (v - b) * quality.STEPS <= v for b, v in zip(got, values)) and got[:4] == values[:4]


# -- Chat.
def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "[", "/", "s>", "INST]", "\n", "$1", "é😀", " "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "", "we</s>ird", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(60) for t in r.sample(range(20), r.randint(1, 8))]
    rows += [(None, 1, "user", "null conversation"), (5000, None, "user", "x"), (5000, 1, "assistant", "y"), (5001, 1, "user", "same"), (5001, 1, "user", "same")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id bigint, turn bigint, role string, text string, msg string")
    got = {x.conv_id: x for x in chat.read_back(chat.render(chat.fold(chat.turns_as_log(df)))).collect()}
    for conv in {x[0] for x in rows}:
        own = sorted(((t if t is not None else -1, ro is not None, ro or "", te is not None, te or "") for c, t, ro, te in rows if c == conv))
        assert [(x.role, x.text) for x in got[conv].turns] == [(ro, te) for _, _, ro, _, te in own]
        assert got[conv].loss == "".join(te for _, _, ro, _, te in own if ro == "assistant")
    assert chat.render(chat.fold(chat.turns_as_log(df.limit(0)))).count() == 0


def test_chat_fold(spark):
    log = [
        ("c", 1, 1, "message", "user", "hi"),
        ("c", 2, 2, "delta", "assistant", "Hel"),
        ("c", 3, 2, "delta", "assistant", "lo"),
        ("c", 4, 3, "message", "user", "void later"),
        ("c", 5, 2, "regenerate", "assistant", None),
        ("c", 6, 2, "delta", "assistant", "Bye"),
        ("c", 7, 3, "message", "user", "again"),
        ("c", 8, 1, "edit", "user", "hi there"),
        ("d", 1, 1, "delta", "assistant", "b"),
        ("d", 0, 1, "delta", "assistant", "a"),
    ]
    df = spark.createDataFrame(log, "conv_id string, seq int, msg int, kind string, role string, text string")
    got = {(x.conv_id, x.msg): (x.role, x.text) for x in chat.fold(df).collect()}
    assert got == {("c", 1): ("user", "hi there"), ("c", 2): ("assistant", "Bye"), ("c", 3): ("user", "again"), ("d", 1): ("assistant", "ab")}
    out = {x.conv_id: x for x in chat.render(chat.fold(df)).collect()}
    assert "".join(s.text for s in out["c"].segments) == out["c"].formatted
    assert [s.text for s in out["c"].segments if s.train] == ["Bye"]


# -- Language.
def plain_phrases(sample, text):
    n, phrase = 1, b""
    for i in range(len(text)):
        c = text[i : i + 1]
        if phrase + c in sample:
            phrase += c
        else:
            n, phrase = n + 1, c if c in sample else b""
    return n


def test_cross_parsing_against_brute_force():
    r = random.Random(4)
    letters = {"xx": "the catsondmz", "ru": "кот сидел на ковре", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 900))) + "，。"}
    samples = {k: "".join(r.choice(x) for _ in range(900)) + "the cat sat on the mat and the dog " * 3 for k, x in letters.items()}
    model = langid.Model(samples)
    every = "".join(letters.values()) + "QЖ\U0001f600\x00"
    texts = ["".join(r.choice(letters[k] if r.random() < 0.9 else every) for _ in range(r.randint(0, 60))) for k in letters for _ in range(30)]
    # Much longer than a stretch, with phrases that cross many of them.
    texts += [samples["zh"] * 3, samples["xx"] * 2 + "the cat sat on the mat and the dog " * 200, "", "q" * 5000]
    texts += ["".join(r.choice([samples["ru"][:400], samples["xx"][:700], "кот ", "Q"]) for _ in range(20)) for _ in range(5)]
    got = model.costs(texts)
    for k, lang in enumerate(model.langs):
        own = langid.encoded(samples[lang])
        want = [plain_phrases(own, langid.encoded(t)) * model.automata[k].bits for t in texts]
        assert got[:, k] == pytest.approx(want)


def test_scripts_and_many_languages_are_told_apart(spark):
    r = random.Random(14)
    scripts = {f"s{k}": (0x4E00 + 700 * k, 700) for k in range(12)} | {"ru": (0x430, 32), "el": (0x3B1, 24), "xx": (0x61, 26)}
    say = lambda at, n, m: "".join(r.choice([chr(at + r.randrange(n))] * 9 + [" "]) for _ in range(m))
    labelled = spark.createDataFrame([(k, say(*x, 800), lang) for lang, x in scripts.items() for k in range(6)], "id int, text string, lang string")
    samples = langid.sample(labelled, 6)
    assert set(samples) == set(scripts)
    asked = spark.createDataFrame([(lang, say(*x, 300)) for lang, x in scripts.items()], "doc_id string, text string")
    assert all(x.id == x.lang_pred for x in langid.identify(asked, samples).collect())


def test_samples_are_whole_rows(spark):
    rows = [(k, f"row {k} " * (400 if k % 2 else 40), "xx") for k in range(60)] + [(99, "long only " * 900, "yy"), (None, None, "zz"), (None, "no label", None), (None, "12", "zz")]
    labelled = spark.createDataFrame(rows, "id int, text string, lang string")
    got = langid.sample(labelled, 10, 1000)
    assert set(got) == {"xx", "yy"} and got["yy"] == rows[60][1]
    parts = got["xx"].split("\n")
    assert 1 <= len(parts) <= 10 and all(p in {x[1] for x in rows if x[0] is not None and x[0] % 2 == 0} for p in parts)


def test_language_of_texts(spark):
    samples = {"a": "abra cadabra abracadabra " * 40, "b": "lorem ipsum dolor sit amet " * 40, "c": "ψηφία και γράμματα " * 40}
    texts = ["abra abracadabra", "ipsum dolor lorem", "γράμματα και", None, "", "123 !?", "ABRA " * 800, "dolor sit " * 20000]
    df = documents(spark, texts)
    got = {x.id: x for x in langid.identify(df, samples).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["a", "b", "c", "und", "und", "und", "a", "b"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), samples).count() == 0
    labelled = df.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") < 3, "zz").alias("lang"))
    assert set(langid.sample(labelled)) == {"zz"} and langid.sample(labelled.limit(0)) == {}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert held and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.97


# -- BPE.
def test_bpe_equals_the_library(spark):
    codec = bpe.codec(PATH, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(5)
    bits = ["a", "the ", "é", "  ", "\n", "\x1c", "\x85", "\u2003", "٣", "²", "x", "ing", "'s", "123", "#!?", "日本", "\u0301", "\U0001f600", "aaaa", "\u180e", "\ufeff", "qzxv" * 9, "<|endoftext|>"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(400)] + ["ab" * 20000, "z" * 70]
    got = {x.id: x for x in bpe.round_trip(documents(spark, texts), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
    two = bpe.decode(bpe.encode(documents(spark, texts), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(x.decoded) == (texts[x.id] or "").encode() for x in two)
    assert bpe.round_trip(documents(spark, texts).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_and_remembers(monkeypatch):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    texts = [f"some words number{i} here{i * 7}" for i in range(200)]
    want = codec.encode_many(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    codec.known.clear()
    assert [codec.encode(t) for t in texts] == want and len(codec.known) <= 20
    for word in ("hello", "reinvention", "éèê", "a" * 300):
        raw = word.encode()
        if raw not in codec.ranks:
            assert np.array(bpe.merge(raw, codec.ranks), "<u4").tobytes() == codec._merge_many([raw], (len(raw) - 2).bit_length())[0]


# -- URLs.
SITES = [("example.org/en/1", "block"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]


def plain_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    for name, verdict in sorted(SITES, key=lambda x: -len(x[0])):
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return host, path, name, verdict
    low = (host + path).lower() if (host + path).isascii() else host + path
    fits = [(len(r.pattern), r.verdict, r.name) for r in urls.PATTERNS if plain_fits(r.pattern, low)]
    return host, path, None, max(fits)[1] if fits else "allow"


def plain_fits(pattern, text):
    """Whether a glob fits a text anywhere, sign by sign."""
    apart = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")

    def here(p, i):
        if not p:
            return True
        if p[0] == "*":
            return any(here(p[1:], j) for j in range(i, len(text) + 1))
        if p[0] == "^":
            return (i < len(text) and apart(text[i]) and here(p[1:], i + 1)) or (i in (0, len(text)) and here(p[1:], i))
        return text[i : i + 1] == p[0] and here(p[1:], i + 1)

    if pattern.startswith("||"):
        end = text.find("/") if "/" in text else len(text)
        return here(pattern[2:], 0) or any(here(pattern[2:], i + 1) for i in range(end) if text[i] == ".")
    return any(here(pattern, i) for i in range(len(text) + 1))


def test_urls(spark):
    r = random.Random(6)
    hosts = ["example.org", "EXAMPLE.ORG", "a.example.org", "xexample.org", "site.com", "casino-win.com", "x.net", "org", "com", "", "adsx.net", "ads.net:80", "adserver.net", "x.popads.co.net", "popads.com", "xpopads.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/15", "/en/2", "/fr/x", "/de/y", "/casino", "/Casino/2", "/uncasino", "?q=casino", "#x", "//x", "/a\nb", "/adult/education", "/adult-x/", "/free/bets", "/free-bets-x", "/free/x/bets", "/click/9/8/ref", "/track/package/1/out/", "/ref/click", "/free/loans/library/", "/free/loans"]
    rows = [(i, f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a=1', '#b', '://y'])}") for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "no scheme.org/"), (5003, "://org/"), (5003, "://org/"), (None, "http://x.org/")]
    got = urls.filtered(spark.createDataFrame([(*x, "c") for x in rows], "page_id bigint, url string, host string")).collect()
    assert len(got) == len(rows)
    have = Counter((x.id, x.host, x.path, x.rule, x.verdict) for x in got)
    assert have == Counter((i, *plain_judge(u)) for i, u in rows)
    assert urls.filtered(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_rule_tokens():
    assert urls.Rule("r", "||example.org/en/1", "block").tokens() == ["en", "example", "org"]
    assert urls.Rule("r", "*track*^ads^", "block").tokens() == ["ads"]
    assert urls.Rule("r", "banner", "block").tokens() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    assert len(urls.PATTERNS) > 200 and sum(len(r.tokens()) > 1 for r in urls.PATTERNS) > 150
    rows = [(f"http://s{i}.net/free/{'loans' if i % 50 else 'bets'}/{i}",) for i in range(500)]
    spark_urls = spark.createDataFrame(rows, "url string")
    filed = {r["name"]: r["token"] for r in urls.filed(urls.PATTERNS, {"free": 500, "loans": 490, "bets": 10})}
    assert filed["^free^bets^"] == "bets" and filed["^free^loans^"] == "loans" and filed["^free^pills^"] == "pills"
    # Only candidates run: every url meets the rules filed under its tokens, not all of them.
    runs = urls.candidates(urls.parts(spark_urls), urls.PATTERNS).groupBy("url").count().agg(F.max("count")).first()[0]
    always = sum(not r.tokens() for r in urls.PATTERNS)
    assert runs - always <= 12 < len(urls.PATTERNS) / 10


def test_rules_without_a_token_still_run(spark):
    rules = [urls.Rule("any", "bann", "block"), urls.Rule("w", "^a*z^", "block")]
    got = {x.url: x.verdict for x in urls.judge(spark.createDataFrame([("h://x/banners",), ("h://x/a/b/z",), ("h://x/y",)], "url string"), rules).collect()}
    assert list(got.values()).count("block") == 2 and got["h://x/y"] == "allow"


# -- Line dedup.
def signed(h):
    return h - (h >> 63 << 64)


def long_hash(x, seed):
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)


def plain_chunks(text):
    """``(first line, lines)`` of each chunk, by the same hashes."""
    own = [m[1] for m in re.finditer(linededup.LINE, text)][:-1]
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in own]
    r = [signed(long_hash(b, long_hash(a, 42))) for a, b in zip(h, h[1:])]
    cuts = [0, *[i + 1 for i in range(1, len(r) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]], len(own)]
    return [(a, own[a:z]) for a, z in zip(cuts, cuts[1:])]


def plain_dedup(rows):
    """Texts of ``rows(id, text)`` without what an earlier place has, by a dictionary of chunks."""
    order = lambda i: (i is not None, i or 0)
    first, seen, count = {}, {}, Counter()
    for i, text in rows:
        mark = signed(xxhash.xxh64_intdigest((text or "").encode(), 42))
        every = plain_chunks(text or "")
        seen[i, mark] = every
        count.update(tuple(own) for _, own in every if len(own) > 1)
        for k, (a, own) in enumerate(every):
            if len(own) > 1:
                place = (order(i), mark, a, every[k - 1][1] if k else [], every[k + 1][1] if k + 1 < len(every) else [])
                first[tuple(own)] = min(first.get(tuple(own), place), place)
    out = []
    for i, text in rows:
        mark = signed(xxhash.xxh64_intdigest((text or "").encode(), 42))
        every, gone = seen[i, mark], set()
        for k, (a, own) in enumerate(every):
            f = first.get(tuple(own))
            if f is None or f[:3] == (order(i), mark, a):
                continue
            before, after = (every[b][1] if 0 <= b < len(every) and count[tuple(every[b][1])] < 2 else [] for b in (k - 1, k + 1))
            lo = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(before[::-1], f[3][::-1])))
            hi = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(after, f[4])))
            gone |= set(range(a - lo, a + len(own) + hi))
        whole = [m[0] for m in re.finditer(linededup.LINE, text or "")]
        for _, run in itertools.groupby(sorted(gone), lambda x, c=itertools.count(): x - next(c)):
            run = list(run)
            if sum(len(whole[x].rstrip(" \t\n\x0b\f\r")) + 1 for x in run) < linededup.MIN_CHARS:
                gone -= set(run)
        out.append(text if text is None else "".join(x for n, x in enumerate(whole) if n not in gone))
    return out


def prose(r, n):
    """``n`` words of invented prose with marks and newlines."""
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 10))) + r.choice(["", "", "", "", ",", ".", ".\n"]) for _ in range(n)).replace("\n ", "\n")


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(7)
    some = [prose(r, r.randint(5, 200)) for _ in range(12)]
    texts = [" ".join(x for _ in range(r.randint(1, 4)) for x in (prose(r, r.randint(0, 60)), r.choice(some))) for _ in range(60)]
    texts += texts[:5] + ODD + ["a b c d e f g h\n" * 300, "\n\n".join(some[:3]), some[0] * 2, "这是第一句话，这是第二句话。" * 20, "\x01\n\n" + some[1]]
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, n, 0, "x") for n, x in enumerate(rows)], "doc_id bigint, text string, n int, hash int, gone string")
    got = {x.row.n: x for x in linededup.deduplicated(df).collect()}
    want = plain_dedup(rows)
    assert [got[n].text for n in range(len(rows))] == want
    assert sum(x.n_removed > 0 for x in got.values()) > 30
    assert all((x.n_removed == 0) == (x.text == x.row.text) for x in got.values())
    assert linededup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [50, 60, 80, 150])
def test_line_dedup_finds_passages_wherever_they_begin(spark, words):
    r = random.Random(words)
    blocks = [prose(r, words) for _ in range(40)]
    rows = [(4 * k + c, f"{prose(r, r.randint(30, 90))} x{k}y{c} {b} {prose(r, r.randint(30, 90))}") for k, b in enumerate(blocks) for c in range(4)]
    got = {x.row.doc_id: x.text for x in linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    cut = sum(min(len(t) - len(got[i]), len(blocks[i // 4])) for i, t in rows if i % 4)
    assert cut >= 0.85 * 3 * sum(map(len, blocks))
    assert sum(blocks[i // 4] in got[i] for i, _ in rows if i % 4) <= 0.05 * 120
    assert all(got[i] == t for i, t in rows if i % 4 == 0)
    # Nothing but the passage goes, save a line at either end that happens to be equal.
    assert all(len(t) - len(got[i]) <= len(blocks[i // 4]) + 1 for i, t in rows)


def test_lines_lose_nothing(spark):
    r = random.Random(8)
    texts = [t for t in ODD if t] + ["a.b , c!?\n\n d", "...", " x", "no end", "x.\r\ny", "中文 abc，def。ghi\n", "\x00 \x01"]
    texts += ["".join(r.choice(["a", "é", "中", "。", "，", " ", "\n", "\t", "\x0b", "\x1c", "\u3000", "longerword", "😀"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.lines(F.col("t")).alias("l"), linededup.lines(F.col("t"), 1).alias("b")).collect()
    assert all("".join(x.l) == x.t and len(x.l) == len(x.b) and not any("\n" in y for y in x.b) for x in rows)


def test_line_dedup_repeated_rows_do_not_remove_each_other(spark):
    r = random.Random(9)
    text, other = prose(r, 100), prose(r, 20)
    df = spark.createDataFrame([(1, text), (1, text), (None, other), (None, text)], "doc_id bigint, text string")
    got = sorted((x.row.doc_id or 0, x.text) for x in linededup.deduplicated(df).collect())
    assert (0, text) in got and (0, other) in got and got[2:] == [(1, got[2][1])] * 2 and len(got[2][1]) < 10


def test_cleaned_rows(spark):
    r = random.Random(10)
    shared, own, little = prose(r, 300), prose(r, 80), prose(r, 10)
    texts = [shared, f"{shared} {own}", f"{shared} {little}", shared, "", None, "one"]
    docs = documents(spark, texts)
    left = linededup.cleaned(docs, min_words=50)
    assert left.columns == docs.columns
    got = {x.doc_id: x for x in left.collect()}
    assert sorted(got) == [0, 1, 4, 5, 6] and got[0].text == shared
    assert got[1].text.endswith(own) and len(got[1].text) < len(own) + 60 and got[1].n_chars == len(got[1].text) and got[0].n_chars == 0
    assert {x.doc_id for x in linededup.cleaned(docs).collect()} == {0, 1, 2, 4, 5, 6}


# -- Personal data.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        for m in regex.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def test_pii_base_equals_brute_force(spark):
    r = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.z", "1", "23", "4111 1111 1111 1111", "4111111111111111", " ", "-", ".", "+1 (555) 123-4567", "+49", "_", "%", "10.0.0.1", "999.1.1.1", "é", "0001.2.3.255", "\n", "(", ")", "5555555555554444", "😀", "7-7"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["1 " * 5000, "a@" + ".b" * 5000, "+1" * 3000]
    got = {x.id: x for x in pii.detected(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain_spans(t), t
    assert pii.detected(documents(spark, texts).limit(0)).count() == 0


def test_pii_bootstraps_contexts(spark):
    seeds = [f"some words here{i} please call helpline +1 555 123 {4000 + i} today" for i in range(12)]
    unseen = ["you may call helpline 0800-44556 any time", "call helpline 0800-99887"]
    plain = [f"item {i} costs 1234{i:03d} in total" for i in range(30)]
    texts = seeds + unseen + plain + [seeds[0]]
    df = documents(spark, texts)
    got = {x.id: x for x in pii.detected(df).collect()}
    for i in (12, 13):
        (s,) = got[i].added
        assert texts[i][s.start : s.end].startswith("0800-") and s.kind == 3
    assert not any(got[i].added for i in range(len(texts)) if i not in (12, 13))
    listed = df.sparkSession.createDataFrame([(1,)], "x int").select(pii.listed(F.from_json(F.lit('[{"start":1,"kind":3,"end":5},{"start":7,"kind":0,"end":9}]'), "array<struct<start:int,kind:int,end:int>>")).alias("l"))
    assert listed.first().l == "phone:1:5,email:7:9"


def test_contract_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op3_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf)
        assert columns <= set(df.columns)
    row = queries.op3_chat(spark, sf).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
