"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions.

A log often holds a conversation several times, each time with more turns. Turns
are numbered by turn, those that tie by the MD5 of role and text; a rolling hash
of the first k turns is the exclusive-or of the turns' 64-bit hashes, each taken
with its number, twice over with other seeds. A conversation whose whole hash is the hash of a shorter
prefix of another one is a snapshot of it and is dropped by an anti-join; of
conversations with the same turns the least conv_id stays. What is left is
rendered, ``SEGMENT`` turn numbers to a row, so a row is bounded.

Hashes are rolled within (conversation, segment) and carried over per segment,
so a conversation with a third of all turns is dealt out by segment; prefix
hashes are made distinct before the join, so a common first turn is one row, and
so are copies of a conversation, by their least conv_id.

Null texts and roles render as empty, a null turn comes first, null conv_ids are
one conversation. Repeated turns count as turns. A very long text is a value of
one row and is rendered whole; a segment of such texts is one row too. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
START, BREAK, STOP = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``key``, a conversation's name that is never null, so joins on
    (key, segment) keep the partitions of the windows and groups before them."""
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1).cast("bigint"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    t = conversations.select("conv_id", key.alias("key"), turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = [F.md5(F.concat("role", F.lit(BREAK), "text")).alias("tie"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), F.col("text"), F.col("role")).alias("b")]
    return t.select("*", F.floor(F.col("turn") / SEGMENT).cast("bigint").alias("segment"), *hashes)


def maximal(conversations: DataFrame) -> DataFrame:
    """(key, segment, conv_id, n_turns, first): the segments of the conversations
    that are no snapshot of another; ``first`` counts the turns before one."""
    t = _turns(conversations).select("conv_id", "key", "segment", "turn", "tie", "a", "b")
    size = t.groupBy("key", "segment").agg(F.count("*").alias("n"), F.first("conv_id").alias("conv_id"))
    order = Window.partitionBy("key").orderBy("segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = Window.partitionBy("key", "segment").orderBy("turn", "tie", "a", "b")
    t = t.join(size.select("key", "segment", "first"), ["key", "segment"]).withColumn("k", F.col("first") + F.row_number().over(place))
    t = t.withColumn("a", F.xxhash64("k", "a")).withColumn("b", F.xxhash64("k", "b"))
    upto = Window.partitionBy("key", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("key", "segment", "k", F.expr("bit_xor(a)").over(upto).alias("a"), F.expr("bit_xor(b)").over(upto).alias("b"))
    # the hashes at each segment's end, rolled over the segments before it
    ends = t.groupBy("key", "segment").agg(F.max("k").alias("k"), F.max_by("a", "k").alias("a"), F.max_by("b", "k").alias("b"))
    rolled = lambda c: F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(f"{c}0")
    ends = ends.select("*", rolled("a"), rolled("b"), F.max("k").over(Window.partitionBy("key")).alias("n_turns"))
    whole_hash = [F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "ab"]
    base = ends.select("key", "segment", "a0", "b0", "n_turns")
    prefix = t.join(base, ["key", "segment"]).where("k < n_turns").select("k", *whole_hash).distinct()
    whole = ends.where("k = n_turns").select("key", "k", *whole_hash).join(size.select("key", "conv_id").distinct(), "key")
    whole = whole.groupBy("k", "a", "b").agg(F.min(F.struct("conv_id", "key")).alias("least"))
    kept = whole.join(prefix, ["k", "a", "b"], "left_anti")
    kept = kept.select("least.key", F.col("k").alias("n_turns"))
    return size.join(kept, "key").select("key", "segment", "conv_id", "n_turns", "first")


def rendered(conversations: DataFrame) -> DataFrame:
    """One row per segment of each maximal conversation: conv_id, segment,
    n_turns (of the conversation), first (turns before the segment), text."""
    kept = maximal(conversations)
    turns = _turns(conversations).select("key", "segment", "turn", "tie", "role", "text").join(kept.select("key", "segment"), ["key", "segment"], "left_semi")
    lines = turns.groupBy("key", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("turns"))
    line = lambda x: F.concat(F.lit(START), x["role"], F.lit(BREAK), x["text"], F.lit(STOP))
    return lines.join(kept, ["key", "segment"]).select("conv_id", "segment", "n_turns", "first", F.array_join(F.transform("turns", line), "").alias("text"))
