"""Audit-trail analytics: debate statistics, calibration bands, queue health, review gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("accepted", "undecided", "rejected", "split")
#: Reasons that always need an operator. Fixed values.
IMMEDIATE = ("conflict", "moderator_block")


def debate_stats(log: DataFrame) -> DataFrame:
    """By outcome: n, mean iterations and confidence, and the share of all debates."""
    own = log.where(F.col("outcome").isin(*OUTCOMES)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("iterations").alias("avg_iterations"), (F.avg("confidence10") / 10).alias("avg_confidence"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 3))


def redebate_arc(log: DataFrame) -> DataFrame:
    """Terms with an undecided debate: when first, and whether accepted after it."""
    first = log.where("outcome = 'undecided'").groupBy("term").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    later = log.where("outcome = 'accepted'").groupBy("term").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return first.join(later, "term", "left").select("term", F.col("first.ts").alias("first_undecided"), F.coalesce(F.col("last") > F.col("first"), F.lit(False)).alias("resolved"))


def band(confidence: Column) -> Column:
    return F.least(F.lit(3), F.floor(F.coalesce(confidence, F.lit(0.0)) / 2.5)).cast("int")


def calibration_bands(proposals: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("decision") == v)
    own = proposals.where("not delegated").groupBy(band(F.col("confidence")).alias("band"))
    return own.agg(F.count(F.lit(1)).alias("decided"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), F.count_if(~F.col("decision").isin("accepted", "rejected")).alias("rolled_back"))


def needs_review(threshold: float = 8.0) -> Column:
    """Immediate reasons; a proposed term never; below the second escalation not yet; then no score or a low one."""
    return (
        F.when(F.col("reason").isin(*IMMEDIATE), True)
        .when(F.col("reason") == "proposed_term", False)
        .when(F.col("escalation") < 2, False)
        .when(F.col("last_confidence").isNull(), True)
        .otherwise(F.col("last_confidence") < threshold)
    )


def queue_health(queue: DataFrame, as_of: str) -> DataFrame:
    """By reason: size, at the highest escalation, age of the oldest in days, mean of the last confidence."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.min("created_at"))) / 86400
    return queue.groupBy("reason").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("escalation") >= 3).alias("at_max"), F.round(age, 1).alias("oldest_days"), F.round(F.avg("last_confidence"), 6).alias("mean_confidence"))
