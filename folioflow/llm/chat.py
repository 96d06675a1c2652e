"""Logged conversations: cumulative snapshots collapsed to the longest, then rendered as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import cut, stored, text_or_empty

#: Rendering of a turn.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, a, b, n_turns): each turn with the hash (a, b) of all turns up to it.

    Turns stand by (turn, role, text); equal rows of a conversation count once, null roles and texts
    are empty. The rolling hash is the exclusive or of the turns' hashes, each taken with its place.
    """
    rows = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).distinct()
    alone = [F.when(F.col("conv_id").isNull(), F.col(c)) for c in ("turn", "role", "text")]  # each row without a conv_id by itself
    one = Window.partitionBy("conv_id", *alone)
    order = one.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(rolling)
    return rows.select("conv_id", "place", "role", "text", part(1).alias("a"), part(2).alias("b"), F.count("*").over(one).alias("n_turns"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_copies, lone) of the conversations that begin no longer one; of equal ones the smallest conv_id stays. lone: the one turn of those without a conv_id."""
    key = ["place", "a", "b"]
    lone = F.first(F.when(F.col("conv_id").isNull(), F.struct("role", "text")), ignorenulls=True)
    whole = turns.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), lone.alias("lone"))
    begun = turns.filter("place < n_turns").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv_id", "n_copies", "lone")


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each maximal conversation of (conv_id, turn, role, text).

    A conversation whose turns (role and text) are the first ones of a longer conversation is left
    out. Each different row without a conv_id is a conversation of one turn, a copy of those that say
    the same. A conversation is one text, so that one has to fit in a task. Other columns are ignored.
    """
    turns = stored(prefixes(conversations), "turns")
    kept = cut(maximal(turns))
    head, middle, tail = TURN.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    rendered = lambda role, text: F.concat(F.lit(head), role, F.lit(middle), text, F.lit(tail))
    rows = turns.join(kept.filter("conv_id is not null").select("conv_id", "n_copies"), "conv_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("turn")))), lambda x: x["turn"])
    named = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(listed, "").alias("text"))
    lone = kept.filter("conv_id is null").select("conv_id", F.lit(1).cast("long").alias("n_turns"), "n_copies", rendered(F.col("lone.role"), F.col("lone.text")).alias("text"))
    return named.unionByName(lone)
