"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A log may hold a conversation many times, each time with more turns. A turn's
rank is its place in its conversation: turns are range-partitioned in order,
counted within each partition, and moved on by the counts before it, so that
no window holds more of a conversation than a partition does, however many
turns are null or alike. The prefix hash at rank k is the exclusive or of two
64-bit hashes of (rank, role, text) over ranks 1 to k, rolled on within blocks
of ``BLOCK`` ranks and over the blocks' sums. A conversation is a
snapshot if its last prefix hash is a proper prefix hash of another one: an
anti-join takes these out. Of equal conversations the smallest id stays.

What stays is rendered in parts of ``BLOCK`` turns: a conversation of any
length never has to fit into one row.

Defined cases: rows with a null conv_id belong to no conversation and are left
out; a null turn comes first; a null role or text counts as empty; a row
repeated as a whole counts once; equal turns go by role, then text. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

BLOCK = 1024


def turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, role, text, rank, n (turns of the conversation) and the hash (a, b) of the prefix up to the turn."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    once = stage(rows.distinct(), "distinct")
    dealt = once.repartitionByRange("conv_id", *order).withColumn("span", F.spark_partition_id())
    ranked = mine = stage(dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order))), "ranked")
    discard(once)
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = mine.groupBy("conv_id", "span").agg(F.count("*").alias("m"))
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.sum("m").over(whole).alias("n"))
    mine = mine.alias("l").join(spans.alias("r"), F.expr("l.conv_id = r.conv_id AND l.span = r.span")).select("l.conv_id", "role", "text", (F.col("k") + F.col("skip")).alias("rank"), "n")
    mine = mine.withColumn("part", F.floor((F.col("rank") - 1) / block)).withColumn("x", F.xxhash64("rank", "role", "text")).withColumn("y", F.xxhash64("text", "role", "rank", F.lit(7)))
    mine = stage(mine, "turns")
    discard(ranked)
    parts = mine.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("px"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("py"))
    roll = Window.partitionBy("conv_id", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rolled = mine.withColumn("x", F.bit_xor("x").over(roll)).withColumn("y", F.bit_xor("y").over(roll)).join(parts, ["conv_id", "part"])
    return rolled.select("conv_id", "role", "text", "part", "rank", "n", F.col("x").bitwiseXOR(F.col("px")).alias("a"), F.col("y").bitwiseXOR(F.col("py")).alias("b"))


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations of ``turns`` that no longer one begins with."""
    whole = rows.where("rank = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = rows.where("rank < n").select(F.col("rank").alias("n"), "a", "b").distinct()
    return whole.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id", "copies")


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, part, n_turns, copies and text of the maximal conversations."""
    rows = stage(turns(conversations, block), "rolled")
    kept = stage(maximal(rows), "kept")
    shown = rows.join(kept, "conv_id").select("conv_id", "part", "n", "copies", F.struct("rank", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")).alias("t")).alias("turn"))
    done = shown.groupBy("conv_id", "part", "n", "copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return done.select("conv_id", "part", F.col("n").alias("n_turns"), "copies", F.array_join(F.col("turns.t"), "").alias("text"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM r),
w AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY n, prefix),
m AS (SELECT w.conv_id, w.copies FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.prefix = w.prefix))
SELECT r.conv_id, (r.k - 1) // 1024 AS part, r.n AS n_turns, m.copies, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS text
FROM r JOIN m ON r.conv_id = m.conv_id GROUP BY r.conv_id, (r.k - 1) // 1024, r.n, m.copies
"""
