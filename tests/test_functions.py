import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from recall_spark.functions import embed, sentiment, text, vector


def each(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aBcéÑ日😀 ") for _ in range(r.randint(0, 9)))
    pairs = [(i, word(), word()) for i in range(300)]
    got = spark.createDataFrame(pairs, "i int, a string, b string").select("i", text.edit_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    # Of an empty side the other one's bytes count.
    want = [distance(a.lower(), b.lower()) if a and b else len((a or b).encode()) for _, a, b in pairs]
    assert [x.d for x in got] == want


def test_tokens(spark):
    values = ["red-green BLUE", "x y zz", " ,;", "é ñandú x1 _ 42", "日 本語\tok"]
    want = [["red", "green", "blue"], ["zz"], [], ["é", "ñandú", "x1", "42"], ["日", "本語", "ok"]]
    assert [list(x) for x in each(spark, text.tokens, values)] == want
    assert [text.query_tokens(v) for v in values] == want


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("<ul><li>tea<li><b>milk</b> jug</ul>", "tea milk jug"),
        ("<script type='x'>if (a < b) go();</script>after", "after"),
        ("before<style media=print>b {}</style>", "before"),
        ("<head><meta charset=utf-8></head><p>page", "page"),
        ("up<hr/>down", "up down"),
        ("<a href='#'></a>", ""),
        ("no markup at all", "no markup at all"),
        ("salt &amp; pepper &lt;ground&gt;", "salt & pepper <ground>"),
        ("5 < 6 and 7 > 6", "5 < 6 and 7 > 6"),
        ("sun ☀️ rain", "sun rain"),
        ("well \U0001f44d done", "well done"),
        ("\U0001f1eb\U0001f1f7 paris", "paris"),
        ("p\x00q\x06r\x0es\x7ft", "pqrst"),
        ("one\ttwo\r\nthree", "one two three"),
        ("\u2003wide   gaps\n\n", "wide gaps"),
        ("", ""),
    ],
)
def test_clean(spark, raw, clean):
    assert each(spark, text.clean, [raw]) == [clean]


def test_content_hash_is_uuid5(spark):
    values = ["abc", "", "héllo", "x" * 1000]
    assert each(spark, text.content_hash, values) == [str(uuid.uuid5(uuid.NAMESPACE_OID, v)) for v in values]


def test_valid_content(spark):
    assert each(spark, text.valid_content, ["a", "", " \n\t", None, "x" * 65536, "x" * 65537, "é" * 32769]) == [True, False, False, False, True, False, False]


def test_truncated(spark):
    assert each(spark, text.truncated, ["x" * 50, "x" * 51]) == ["x" * 50, "x" * 50 + "..."]


@pytest.mark.parametrize("most", [100, 10, 5, 6, 1])
def test_chunks_lose_no_word(spark, most):
    body = "One two three. Four five! Six seven eight nine ten eleven twelve? End. " * 3
    (got,) = each(spark, lambda c: text.chunks(c, most), [body])
    assert " ".join(got).split() == body.split()
    assert all(len(c.split()) <= max(most, 7) for c in got)


def test_vectors(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], 0), ([1.0], [1.0, 2.0], 0), (None, [1.0], 0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a array<float>, b array<float>").orderBy("i")
    assert [r.c for r in rows.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [c for *_, c in pairs]
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<float>, b array<float>")
    assert one.select(vector.dot(F.col("a"), F.col("b")).alias("d")).first().d == 32
    n = one.select(vector.normalised(F.col("a")).alias("n"), vector.cosine_to(F.col("a"), [4.0, 5.0, 6.0]).alias("c")).first()
    assert math.isclose(sum(x * x for x in n.n), 1) and math.isclose(n.c, 32 / math.sqrt(14 * 77))
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<float>").select(vector.normalised(F.col("a")).alias("n")).first().n
    assert zero == [0.0, 0.0]


def test_sentiment(spark):
    ladder = [(0.6, 0, 0, "happiness"), (0.2, 0, 0, "surprise"), (0.0, 0, 0, "neutral"), (-0.2, 0, 0, "sadness"), (-0.7, 0.8, 0.2, "anger"), (-0.7, 0.3, 0.7, "fear"), (-0.7, 0.5, 0.5, "disgust"), (-0.7, 0.5, 0.0, "anger")]
    rows = spark.createDataFrame([(float(c), float(n), float(u)) for c, n, u, _ in ladder], "c double, n double, u double")
    assert [r.x for r in rows.select(sentiment.label(F.col("c"), F.col("n"), F.col("u")).alias("x")).collect()] == [x for *_, x in ladder]
    boost = lambda a, b: spark.range(1).select(sentiment.boost(F.lit(a), F.lit(b)).alias("b")).first().b
    assert [boost("fear", "fear"), boost("happiness", "fear"), boost("fear", "anger"), boost("neutral", "fear"), boost("happiness", "surprise")] == [1.2, 0.8, 1.0, 1.0, 1.0]
    got = [r.sentiment_label for r in sentiment.analysed(spark.createDataFrame([(0, "I love this great thing"), (1, "hate this terrible awful pain"), (2, "the table"), (3, "")], "i int, content string")).orderBy("i").collect()]
    assert got[0] == "happiness" and got[1] in sentiment.NEGATIVE and got[2] == got[3] == "neutral"


def test_embedders(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "other words"), (4, "")], "id int, content string")
    out = {r.id: r.embedding for r in embed.HashingEmbedder(16).embed(rows).collect()}
    assert out[1] == out[2] != out[3] and math.isclose(sum(x * x for x in out[1]), 1, rel_tol=1e-5) and not any(out[4])
    chunked = embed.embedded_chunks(rows.where("id < 4"), embed.HashingEmbedder(8), ["id"], most=2).collect()
    assert {r.id for r in chunked} == {1, 2, 3} and all(len(r.embedding) == 8 for r in chunked)
    table = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<float>")
    joined = embed.PrecomputedEmbedder(table).embed(rows, "id").collect()
    assert {r.id: r.embedding for r in joined} == {1: [1.0, 0.0], 2: None, 3: None, 4: None}


def test_query_expansion():
    assert text.expanded_query("cats", 1, 2) == "search for information about cats search for information about cats"
    assert text.expanded_query("a b c d", 4, 1) == "a b c d"
