"""Preference formatting of paired conversations.

Turns are rows throughout: the two conversations of a pair meet turn by turn in one aggregation, the first turn that
differs is a minimum a pair, and each turn is rendered on its own.  No conversation is gathered into one row, so one
with very many turns is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import need, salted_join


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _plain(text: Column) -> Column:
    """A text with the template's marks broken up by a space."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, segment, turn, role, rendered, train_from, train_chars) of rows (pair_id, side, turn, role, text).

    ``side`` is chosen or rejected.  Turns before the first that differs, the longest common prefix, are rendered once
    as segment prompt; from there on each side's turns are rendered as segments chosen and rejected.  Joining a
    segment's rows in order of turn gives its text: prompt + chosen and prompt + rejected are the two conversations.
    A completion's assistant turns are trained on from code point ``train_from`` of ``rendered`` for ``train_chars``
    code points (the text and its end mark); everything else is masked (train_chars 0).

    Null roles are user, null texts empty; rows without pair, side or turn, or with another side, are left out.  Of
    rows that repeat a turn, the smallest (role, text) counts.  Conversations that don't differ are all prompt, and a
    conversation that is the start of the other has an empty completion.  Marks of the template within texts
    and roles are broken up by a space.  An empty table gives no rows.
    """
    rows = need(turns, "pair_id", "side", "turn", "role", "text").where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    said = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda s: F.min(F.when(F.col("side") == s, said)).alias(s)
    both = rows.groupBy("pair_id", "turn").agg(side("chosen"), side("rejected"))
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))).alias("first"))
    each = salted_join(both, split, "pair_id", F.col("turn"))
    prompt = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    segment = lambda name, what: F.struct(F.lit(name).alias("segment"), F.col(what).alias("said"))
    parts = F.when(prompt, F.array(segment("prompt", "chosen"))).otherwise(F.array(segment("chosen", "chosen"), segment("rejected", "rejected")))
    out = each.select("pair_id", "turn", F.explode(parts).alias("p")).where("p.said is not null").select("pair_id", F.col("p.segment").alias("segment"), "turn", _plain(F.col("p.said.role")).alias("role"), _plain(F.col("p.said.text")).alias("text"))
    head, end = _header(F.col("role")), F.lit("<|end|>\n")
    trained = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    return out.select(
        "pair_id", "segment", "turn", "role", F.concat(head, F.col("text"), end).alias("rendered"),
        F.when(trained, F.char_length(head)).otherwise(0).cast("long").alias("train_from"),
        F.when(trained, F.char_length("text") + 7).otherwise(0).cast("long").alias("train_chars"),
    )


def cut_answers(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, side, turn, role, text) of (conv_id, turn, role, text): a conversation is chosen over itself with
    its last assistant turn cut to the first half of its words, the usual made-up negative of a broken-off answer.

    A null conversation has no last turn and is not cut; null texts stay null; rows that repeat stay; a conversation
    without an assistant is paired with itself unchanged; an empty table gives no rows.
    """
    rows = need(conversations, "conv_id", "turn", "role", "text")
    last = rows.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    rows = salted_join(rows, last, "conv_id", F.col("turn"), "left")
    words = F.split("text", " ")
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), cut.alias("text")))
    return rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
