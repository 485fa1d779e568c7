"""Consensus over votes (key, pass, relation, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_a_pass(votes: DataFrame) -> DataFrame:
    """The vote of each key's pass: of several the one with the highest confidence, then the first relation."""
    w = Window.partitionBy("key", "pass").orderBy(F.desc("confidence"), "relation")
    return votes.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def unanimous(votes: DataFrame) -> DataFrame:
    """key, relation, confidence of relations that every pass of a key proposes; the confidence is the least."""
    passes = votes.groupBy("key").agg(F.count_distinct("pass").alias("passes"))
    each = votes.groupBy("key", "relation").agg(F.count_distinct("pass").alias("n"), F.min("confidence").alias("confidence"))
    return each.join(passes, "key").where("n = passes").select("key", "relation", "confidence")


def majority(votes: DataFrame, threshold: float = 8.0) -> DataFrame:
    """key, outcome, relation, confidence by strict majority. none wins: rejected, with the median of its votes. A type
    wins: the median over all votes for a type; accepted from the threshold on. No majority: unresolved, with the least."""
    total = votes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"), F.median(F.when(F.col("relation") == "none", F.col("confidence"))).alias("none_median"), F.median(F.when(F.col("relation") != "none", F.col("confidence"))).alias("typed_median"))
    top = votes.groupBy("key", "relation").agg(F.count(F.lit(1)).alias("votes")).groupBy("key").agg(F.max_by("relation", "votes").alias("relation"), F.max("votes").alias("votes"))
    won = F.col("votes") * 2 > F.col("n")
    none = F.col("relation") == "none"
    outcome = F.when(~won, "unresolved").when(none, "rejected").when(F.col("typed_median") >= threshold, "accepted").otherwise("unresolved")
    confidence = F.when(~won, F.col("least")).when(none, F.col("none_median")).otherwise(F.col("typed_median"))
    return total.join(top, "key").select("key", outcome.alias("outcome"), F.when(won, F.col("relation")).alias("relation"), confidence.cast("double").alias("confidence"))
