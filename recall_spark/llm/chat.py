"""Chat formatting from event logs: fold a conversation's events into messages, then render them.

A log has one row for each event: conversation, sequence number, message number, kind, role and
text. Kinds: ``message`` (a whole message), ``delta`` (streamed text, appended), ``edit`` (the text
so far is replaced) and ``regenerate`` (the message starts anew and all that earlier events said in
later messages is void). Events are taken by sequence number; ties go by kind, role and text.

The template is ``<s>[INST] role [/INST]text</s>`` for each message. In roles and texts a backslash
is doubled and a backslash breaks each of the four control strings, so that a rendered conversation
always splits back into the messages it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"([<\[])(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_as_log(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as a log of whole messages.

    Each row is a message of its own, repeated rows and equal turns too (by turn, role, text); a null
    role or text counts as empty. Other columns are dropped.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("conv_id", F.row_number().over(by).cast("long").alias("msg"), F.lit("message").alias("kind"), "role", "text").withColumn("seq", F.col("msg"))


def fold(log: DataFrame) -> DataFrame:
    """``(conv_id, msg, role, text)``: the messages that a log leaves.

    Every window and group is keyed by conversation, so one shuffle serves them all; within it rows
    are sorted and may spill. A message's role is that of its first event that counts.
    """
    order = ("seq", "kind", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    message = Window.partitionBy("conv_id", "msg").orderBy(*order)
    whole = Window.partitionBy("conv_id", "msg")
    clean = log.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("msg").cast("long").alias("msg"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    void = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    live = clean.withColumn("void", void).where("void is null or seq > void").withColumn("n", F.row_number().over(message))
    fresh = live.withColumn("reset", F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("n"))).over(whole)).where("reset is null or n >= reset")
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return fresh.groupBy("conv_id", "msg").agg(F.min_by("role", "n").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, segments)`` for each conversation of ``fold``.

    ``segments`` is ``formatted`` in pieces, each with ``train``: whether it is under the loss mask,
    which is so for exactly the texts of role ``trained``. Turns are escaped before they are grouped;
    only finished pieces of one conversation meet in a task.
    """
    head = F.concat(F.lit(f"{BEGIN}{OPEN} "), escape(F.col("role")), F.lit(f" {CLOSE}"))
    one = messages.select("conv_id", "msg", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("train"))
    turns = F.array_sort(F.collect_list(F.struct("msg", "head", "body", "train")))
    piece = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(piece(t["head"], F.lit(False)), piece(t["body"], t["train"]), piece(F.lit(END), F.lit(False)))))
    segments = one.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", pieces.alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(rendered: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss, formatted)`` parsed from the output: roles and texts, and the text under the mask."""
    pattern = r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$"
    chunks = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescape(s["text"])), "")
    return rendered.select("conv_id", F.transform(chunks, turn).alias("turns"), loss.alias("loss"), "formatted")
