"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

The longest common prefix of turns (equal role and text, from the first turn on) is rendered once, as
the prompt. What follows in each conversation is its completion; its mask is the list of character
ranges of the assistant's texts, which are all that a loss should see.

Turns are compared position by position over a shuffle on the pair; a task holds one pair's turns
at a time, never a group of pairs.

A mask takes in the line break that ends the assistant's turn, so a stop is learned. Role markers that stand
in a text are broken by a backslash, so that no text can pass for a turn of its own.

Results for odd input: turns with equal numbers are ordered by role and text; null roles and texts count as
empty; a pair with one conversation has no common turns, and its missing completion is null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _head(role: Column) -> Column:
    return F.length(role) + 5


def preference_rows(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. pairs: pair_id, conv_id, side ('chosen' or 'rejected').

    Returns pair_id, n_prompt_turns, prompt, and for each side its text (chosen, rejected) and mask (chosen_mask, rejected_mask: arrays of start and end)."""
    turns = turns.select("conv_id", "turn", *[escaped(F.coalesce(c, F.lit(""))).alias(c) for c in ("role", "text")])
    rows = turns.join(pairs.select("pair_id", "conv_id", "side"), "conv_id")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    place = Window.partitionBy("pair_id", "at")
    both = F.struct("role", "text")
    rows = rows.withColumn("same", (F.count("*").over(place) == 2) & (F.min(both).over(place) == F.max(both).over(place)))
    rows = rows.withColumn("first", F.min(F.when(~F.col("same"), F.col("at"))).over(Window.partitionBy("pair_id")))
    rows = rows.withColumn("in_prompt", F.col("first").isNull() | (F.col("at") < F.col("first"))).withColumn("piece", rendered(F.col("role"), F.col("text")))
    own = Window.partitionBy("pair_id", "side", "in_prompt").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(own), F.lit(0)) + _head(F.col("role")))
    rows = rows.withColumn("range", F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("text") + 1).alias("end")))
    listed = lambda keep, what: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", what)))), lambda x: x[what])
    text = lambda keep: F.array_join(listed(keep, "piece"), "")
    out = [F.max(F.when(F.col("in_prompt"), F.col("at"))).alias("n_prompt_turns")]
    any_side = F.min("side").over(Window.partitionBy("pair_id"))
    rows = rows.withColumn("one_side", any_side)
    out.append(text(F.col("in_prompt") & (F.col("side") == F.col("one_side"))).alias("prompt"))
    for side in ("chosen", "rejected"):
        here = (F.col("side") == side) & ~F.col("in_prompt")
        there = F.max(F.col("side") == side)
        out.append(F.when(there, text(here)).alias(side))
        out.append(F.when(there, listed(here & (F.col("role") == ASSISTANT), "range")).alias(f"{side}_mask"))
    return rows.groupBy("pair_id").agg(*out).withColumn("n_prompt_turns", F.coalesce("n_prompt_turns", F.lit(0)))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    return ids.select(F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 != 0, 1, 0)").alias("pair_id"), "conv_id", F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"))
