"""Sentiment: a small lexicon scorer, the label ladder and the boost between labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_spark.functions.binding import let

HAPPINESS, SURPRISE, SADNESS, ANGER, FEAR, DISGUST, NEUTRAL = "happiness", "surprise", "sadness", "anger", "fear", "disgust", "neutral"
POSITIVE = (HAPPINESS, SURPRISE)
NEGATIVE = (SADNESS, FEAR, ANGER, DISGUST)

#: Our own valences, -4 to 4. The published lexicon isn't part of this repository.
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2, "delight": 2.9, "enjoy": 2.2, "excellent": 2.7, "fantastic": 2.6,
    "glad": 2.0, "good": 1.9, "great": 3.1, "happy": 2.7, "helpful": 1.8, "hope": 1.9, "like": 1.5, "love": 3.2, "nice": 1.8,
    "perfect": 2.7, "pleased": 1.9, "thanks": 1.9, "win": 2.8, "wonderful": 2.7, "wow": 2.8,
    "afraid": -2.0, "angry": -2.3, "annoyed": -1.6, "awful": -2.0, "bad": -2.5, "broken": -2.1, "cry": -2.1, "disgust": -2.9,
    "disgusting": -2.4, "fail": -2.5, "fear": -2.2, "furious": -2.7, "hate": -2.7, "horrible": -2.5, "hurt": -2.4, "pain": -2.3,
    "poor": -2.1, "problem": -1.7, "sad": -2.1, "scared": -1.9, "terrible": -2.1, "ugly": -2.3, "worst": -3.1, "wrong": -2.1,
}
NEGATIONS = ("not", "no", "never", "cannot", "without", "nor")


def scores(text: Column) -> Column:
    """``struct<pos,neg,neu,compound>`` of a text: valences summed, flipped after a negation, squashed
    by ``x / sqrt(x * x + 15)``."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}']+", " ")), " "), lambda w: w != "")
    lexicon = F.create_map(*[F.lit(x) for k, v in LEXICON.items() for x in (k, v)])
    valued = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.struct(w.alias("w"), before.alias("before")))
    signs = F.transform(
        F.filter(valued, lambda x: x["w"].isNotNull()),
        lambda x: F.coalesce(lexicon[x["w"]], F.lit(0.0)) * F.when(x["before"].isin(*NEGATIONS), -0.74).otherwise(1.0),
    )
    return let(signs, _summed)


def _summed(signs: Column) -> Column:
    fold = lambda keep, add: F.aggregate(F.filter(signs, keep), F.lit(0.0), lambda s, x: s + add(x))
    sums = F.struct(
        fold(lambda x: x > 0, lambda x: x + 1).alias("pos"),
        fold(lambda x: x < 0, lambda x: 1 - x).alias("neg"),
        F.size(F.filter(signs, lambda x: x == 0)).cast("double").alias("neu"),
        F.aggregate(signs, F.lit(0.0), lambda s, x: s + x).alias("total"),
    )

    def shares(s: Column) -> Column:
        every = s["pos"] + s["neg"] + s["neu"]
        share = lambda k: F.when(every > 0, s[k] / every).otherwise(0.0).alias(k)
        return F.struct(share("pos"), share("neg"), share("neu"), (s["total"] / F.sqrt(s["total"] * s["total"] + 15)).alias("compound"))

    return let(sums, shares)


def label(compound: Column, neg: Column, neu: Column) -> Column:
    """The ladder from scores to a basic emotion."""
    strong = F.when((neu <= 0) | (neg / neu > 1.5), ANGER).when(neu > neg, FEAR).otherwise(DISGUST)
    return F.when(compound >= 0.6, HAPPINESS).when(compound >= 0.2, SURPRISE).when(compound <= -0.6, strong).when(compound <= -0.2, SADNESS).otherwise(NEUTRAL)


def boost(query: Column, node: Column) -> Column:
    """1.2 for equal labels, 0.8 for opposite valence, else 1."""
    opposite = (query.isin(*POSITIVE) & node.isin(*NEGATIVE)) | (query.isin(*NEGATIVE) & node.isin(*POSITIVE))
    return F.when((query == NEUTRAL) | (node == NEUTRAL), 1.0).when(query == node, 1.2).when(opposite, 0.8).otherwise(1.0)


def factor(query: Column, node: Column) -> Column:
    """The search multiplier: 1 for a neutral query and for nodes without a label."""
    return F.when((query == NEUTRAL) | node.isNull() | (node == ""), 1.0).otherwise(boost(query, node))


def analysed(df, text_col: str = "content"):
    """``df`` with ``sentiment_label`` and ``sentiment_score`` of a text column."""
    s = scores(F.coalesce(F.col(text_col), F.lit("")))
    return df.select("*", F.explode(F.array(s)).alias("_s")).withColumns({"sentiment_label": label(F.col("_s.compound"), F.col("_s.neg"), F.col("_s.neu")), "sentiment_score": F.col("_s.compound")}).drop("_s")
