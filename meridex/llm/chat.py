"""Chat formatting with cumulative-snapshot collapse.

Services log a conversation again and again as it grows. A conversation's turns, in order, get rolling prefix hashes
(128 bits: running exclusive-or over the hashes of position, role and text); one whose whole hash is a proper prefix hash
of another is a snapshot, and an anti-join drops it. Of equal conversations the smallest conv_id stays. What is left is
rendered, turn by turn, in order. JVM-side throughout. Turns are dealt by conversation and stretch of turns, so that one
very long conversation is many tasks' work (only sums over its stretches, a STRETCH-th of its turns, are one task's), and
renders are cut into parts of PART turns.

Defined cases: turns are ordered by turn, role and text, nulls first; a null role renders as "user", a null text as empty;
turns with a null conv_id make up one conversation; repeated rows are turns of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, written

STRETCH = 64
PART = 1024


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns (cid, pos, role, text; pos from 1), and the conversations that stay (cid, n_turns, copies)."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"), F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / STRETCH).alias("stretch"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = rows.groupBy("cid", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("cid", "stretch", (F.sum("n").over(Window.partitionBy("cid").orderBy("stretch")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("cid", "stretch").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("own", F.row_number().over(inside)).join(before, ["cid", "stretch"]).withColumn("pos", F.col("before") + F.col("own"))
    rows = written(rows.select("cid", "stretch", "pos", "role", "text", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64("text", "pos", "role", F.lit(7)).alias("b")), "turns")
    # rolling hashes: over the stretches before, then inside the stretch
    tops = rows.groupBy("cid", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    w = Window.partitionBy("cid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("cid", "stretch", F.coalesce(F.bit_xor("a").over(w), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("b").over(w), F.lit(0)).alias("b0"))
    w = Window.partitionBy("cid", "stretch").orderBy("pos")
    rolling = rows.select("cid", "stretch", "pos", F.bit_xor("a").over(w).alias("a"), F.bit_xor("b").over(w).alias("b")).join(tops, ["cid", "stretch"])
    rolling = written(rolling.select("cid", "pos", F.col("a").bitwiseXOR(F.col("a0")).alias("a"), F.col("b").bitwiseXOR(F.col("b0")).alias("b")), "rolling")
    lengths = written(rolling.groupBy("cid").agg(F.max("pos").alias("n_turns")), "lengths")
    ends = join_groups(rolling, lengths, ["cid"], "n_turns", rolling.count())
    whole = ends.where("pos = n_turns").groupBy("n_turns", "a", "b").agg(F.min_by("cid", F.struct(F.expr("try_cast(cid AS bigint)"), "cid")).alias("cid"), F.count(F.lit(1)).alias("copies"))
    proper = ends.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "a", "b").distinct()
    return rows, whole.join(proper, ["n_turns", "a", "b"], "left_anti").select("cid", "n_turns", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns, copies, text: what the maximal conversations render to, PART turns a row."""
    rows, kept = maximal_conversations(turns)
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    part = F.floor((F.col("pos") - 1) / PART).cast("int")
    kept = written(kept, "kept")
    parts = join_groups(rows, kept, ["cid"], "n_turns", rows.count()).groupBy("cid", part.alias("part"), "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return parts.select(F.when(F.col("cid") != "", F.col("cid").cast("long")).alias("conv_id"), "part", "n_turns", "copies", F.array_join(F.transform("x", lambda x: x["line"]), "").alias("text"))


ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER w AS pos, '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS line
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, ''))),
p AS (SELECT conv_id, pos, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT prefix AS text, n AS n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY ALL)
SELECT conv_id, CAST(0 AS INTEGER) AS part, n_turns, copies, text FROM whole WHERE text NOT IN (SELECT prefix FROM p WHERE pos < n)
"""
