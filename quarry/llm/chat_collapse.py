"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation is often logged again with more turns. Each turn gets a rolling hash of all turns up to it; a
conversation whose whole hash is the hash of a proper prefix of another one is dropped by an anti-join, and of equal
conversations the one with the smallest conv_id stays. What is left is rendered with a role template.

Turns are ordered by (turn, role, text) and dealt out in chunks of CHUNK turn numbers, so that one conversation with
most of all rows is spread over many tasks: hashes roll inside a chunk, and chunk totals roll over chunks. The rendered
text comes in parts of one chunk each; a conversation of fewer turns has one part.

Defined results: null text or role is empty; a null turn sorts last; null conv_id is one conversation of its own;
repeated turns count as turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import run_dir, stored

CHUNK = 256
LAST = 2**63 - 1
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    order = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    return conversations.select(
        F.col("conv_id"), order.alias("ord"), F.floor(order / CHUNK).cast("long").alias("chunk"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _rolled(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns up to this one), h1, h2 (their rolling hash), last (whether it is the conversation's last)."""
    inside = Window.partitionBy("conv_id", "chunk").orderBy("ord", "role", "text")
    own = lambda salt: F.xxhash64(F.lit(salt), "role", F.lit(salt), "text")
    turns = turns.select("conv_id", "chunk", F.row_number().over(inside).alias("nth"), own(1).alias("own1"), own(2).alias("own2"))  # texts go no further
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("size"))
    starts = chunks.select("conv_id", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy("conv_id")).alias("total"))
    same = F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("chunk") == F.col("its_chunk"))
    keyed = lambda df: df.withColumnsRenamed({"conv_id": "its_conv", "chunk": "its_chunk"})
    placed = turns.join(keyed(starts), same).select("conv_id", "chunk", "nth", (F.col("start") + F.col("nth")).alias("n"), "total", "own1", "own2")
    hashed = placed.select("conv_id", "chunk", "nth", "n", "total", *(F.xxhash64(F.lit(salt), "n", f"own{salt}").alias(f"h{salt}") for salt in (1, 2)))
    running = Window.partitionBy("conv_id", "chunk").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "chunk", "n", "total", *(F.bit_xor(h).over(running).alias(h) for h in ("h1", "h2")))
    totals = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    carried = totals.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(h).over(before), F.lit(0).cast("long")).alias(f"c{h}") for h in ("h1", "h2")))
    whole = (F.col("n") == F.col("total")).alias("last")
    return rolled.join(keyed(carried), same).select("conv_id", "n", *(F.col(h).bitwiseXOR(F.col(f"c{h}")).alias(h) for h in ("h1", "h2")), whole)


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    rolled = stored(_rolled(_turns(conversations)), f"{run_dir(conversations.sparkSession, 'chat')}/rolled")
    whole = rolled.where("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = rolled.where("not last").select("n", "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    opens, then, ends = map(F.lit, TEMPLATE)
    return F.concat(opens, role, then, text, ends)


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the whole conversation), text: the maximal conversations, rendered."""
    kept = stored(maximal(conversations), f"{run_dir(conversations.sparkSession, 'chat')}/kept").withColumnRenamed("conv_id", "kept_id")
    turns = _turns(conversations)
    turns = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"]))
    parts = turns.groupBy("conv_id", "chunk", "n_turns").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: rendered_turn(t["role"], t["text"])), "")
    return parts.select("conv_id", F.col("chunk").alias("part"), "n_turns", text.alias("text"))
