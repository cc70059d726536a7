"""Chat formatting after a collapse of cumulative snapshots, in DataFrame functions only (operator 4).

Logs often hold a conversation several times, each snapshot a prefix of the next.  A rolling hash
of every turn prefix (the xor of the hashes of its turns, each hashed with its position, in two
independent 64-bit lanes) identifies conversations that are a prefix of a longer one; an anti-join
drops them.  Of equal conversations the one with the least conv_id stays.  What stays is rendered,
a block per turn.

Positions and prefixes are computed in blocks of ``BLOCK`` turns and then shifted by the totals of the
blocks before, so a very long conversation is spread over many tasks; prefixes are made distinct before the
anti-join, so a very common first turn is one row.  Texts move twice, to their block and, rendered, to their
conversation; hashes, positions and the anti-join go over rows without texts.

Defined results: rows without conv_id are dropped; rows equal in conv_id, turn, role and text count once;
turns are ordered by turn (null first), role and text; null role is ``unknown``, null text is empty; control marks inside
texts are broken with a backslash; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def distinct_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, text: distinct turns, dealt by (conv_id, block) so that no later step by block moves them again."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.repartition("conv_id", "block").distinct()


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (from 1), n (turns of the conversation), p1 and p2 (hashes of the prefix up to this turn), without texts."""
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    slim = turns.select(
        "conv_id",
        "block",
        F.row_number().over(in_block).alias("k"),
        F.xxhash64("role", "text").alias("a1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("a2"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = slim.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    shift = sizes.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"),
        F.sum("size").over(whole).alias("n"),
    )
    slim = slim.join(shift, ["conv_id", "block"]).withColumn("pos", F.col("k") + F.col("shift"))
    slim = slim.withColumns({"h1": F.xxhash64("pos", "a1"), "h2": F.xxhash64("a2", "pos")})
    upto = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    slim = slim.withColumns({"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto)})
    totals = slim.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    carried = totals.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("c2"),
    )
    slim = slim.join(carried, ["conv_id", "block"])
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    return slim.select("conv_id", "block", "pos", "n", xor("x1", "c1").alias("p1"), xor("x2", "c2").alias("p2"))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another, and the least of equal ones."""
    full = hashed.where("pos = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return full.join(prefixes, ["n", "p1", "p2"], "left_anti").select("conv_id")


def rendered_turn(role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE), F.lit("\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation."""
    turns = distinct_turns(conversations)
    kept = maximal_conversations(with_prefix_hashes(turns))
    blocks = turns.select("conv_id", "block").distinct().join(kept, "conv_id", "left_semi")
    rows = turns.join(blocks, ["conv_id", "block"], "left_semi")
    rows = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    drawn = F.array_join(F.transform("s", lambda t: rendered_turn(t["role"], t["text"])), "")
    parts = rows.select("conv_id", F.size("s").cast("long").alias("size"), F.struct("block", drawn.alias("t")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("size").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", "n_turns", F.array_join("parts.t", "").alias("rendered"))
