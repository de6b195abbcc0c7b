"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold every state of a conversation: each snapshot repeats all turns so
far and adds some.  A snapshot is a proper prefix of a longer one exactly if the hash of
all its turns equals the hash of as many leading turns of the longer one.  Hashes of
prefixes are rolled over the turns by a running window, in time by their number; an anti
join keeps the conversations that no longer one continues, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROLES = ("system", "user", "assistant", "tool")


def render(turns: Column, begin: str = "<|{}|>", end: str = "<|end|>") -> Column:
    """Text of an array of ``role, text`` structs: a mark with the role, the text, an end mark.

    ``begin`` holds one ``{}``, which the role replaces.
    """
    before, after = begin.split("{}")
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after + "\n"), t["text"], F.lit(end))), "\n"
    )


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_snapshots, text``: the maximal conversations, rendered.

    Input rows have ``conv_id, turn, role, text``.  A conversation is the sequence of its
    turns in the order of ``turn``, then role and text; repeated rows are repeated turns.
    Null roles count as ``user``, null texts as empty, rows without a conv_id as one
    conversation.  Conversations that are a prefix of a longer one, with equal roles and
    texts, are left out; of equal ones the smallest conv_id stays.  ``n_snapshots`` counts
    the conversations (this one included) that are equal to the one that stayed.  Turns
    are compared by two 64-bit hashes rolled over them.  A conversation must fit a task.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # One sort per conversation; the hash of a prefix follows from that of the one before it and its last turn.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("n", F.row_number().over(order))
    hashes = F.xxhash64("n", "role", "text"), F.xxhash64("text", "role", F.lit(7), "n")
    rolled = placed.select(
        "conv_id", F.struct("n", *(F.bit_xor(h).over(order).alias(c) for h, c in zip(hashes, "ab"))).alias("key"),
        F.lead("n").over(order).isNotNull().alias("goes_on"),
    )
    # Every proper prefix that some conversation continues; a popular one is one row per task after the partial distinct.
    prefixes = rolled.filter("goes_on").select("key").distinct()
    same = rolled.filter("NOT goes_on").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    kept = same.join(prefixes, "key", "left_anti").select("conv_id", F.col("key.n").alias("n_turns"), "n_snapshots")
    chosen = turns.join(kept, turns["conv_id"].eqNullSafe(kept["conv_id"])).select(
        turns["conv_id"], "n_turns", "n_snapshots", "turn", "role", "text"
    )
    return (
        chosen.groupBy("conv_id", "n_turns", "n_snapshots")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_snapshots", render(F.col("turns")).alias("text"))
    )
