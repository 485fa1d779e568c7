"""Parts of the effectiveness report: proposals, the queue by escalation, reviews, rates, and definitions that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import stripped

#: The escalation from which an item is at its last; decisions that a band needs to be compared; the shares
#: of undecided debates and of reviews without an action from which they are findings.
LAST_ESCALATION, BAND_DECISIONS, UNDECIDED_SHARE, NO_ACTION_SHARE = 3, 3, 0.5, 0.9


def rate(part: Column, whole: Column) -> Column:
    """part of whole, or null of nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """by (status or action_type), value, n of proposals; a missing value is unknown."""
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("by"), F.coalesce(c, F.lit("unknown")).alias("value")) for c in ("status", "action_type"))))
    return proposals.select(names.alias("x")).groupBy("x.by", "x.value").agg(F.count(F.lit(1)).alias("n"))


def queue_escalations(queue: DataFrame) -> DataFrame:
    """escalation (0 where it is missing), n, at_max."""
    level = F.coalesce("escalation", F.lit(0))
    return queue.groupBy(level.alias("escalation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(level >= LAST_ESCALATION).alias("at_max"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """trigger (null: all), total, with_actions, avg_actions, no_action_rate of reviews (trigger, actions array). Without
    reviews there is the row of all, with 0 and nulls."""
    size = F.greatest(F.lit(0), F.size(F.coalesce("actions", F.array().cast(reviews.schema["actions"].dataType))))
    rows = reviews.select(F.coalesce("trigger", F.lit("unknown")).alias("trigger"), size.alias("k"))
    own = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("k") > 0).alias("with_actions"), F.round(F.avg("k"), 2).alias("avg_actions")]
    both = rows.groupBy("trigger").agg(*own).unionByName(rows.agg(*own).withColumn("trigger", F.lit(None).cast("string")))
    return both.withColumn("no_action_rate", rate(F.col("total") - F.col("with_actions"), F.col("total")))


def calibration(bands: DataFrame) -> DataFrame:
    """first_rate, last_rate, holds of bands (band, decided, accepted): whether, of the bands with three decisions or more,
    the last is accepted more often than the first. No row with fewer than two of them."""
    fit = bands.where(F.col("decided") >= BAND_DECISIONS).withColumn("rate", rate(F.col("accepted"), F.col("decided")))
    ends = fit.agg(F.count(F.lit(1)).alias("n"), F.min_by("rate", "band").alias("first_rate"), F.max_by("rate", "band").alias("last_rate"))
    return ends.where("n >= 2").select("first_rate", "last_rate", (F.col("last_rate") > F.col("first_rate")).alias("holds"))


def findings(undecided: Column, debates: Column, at_max: Column, no_action_rate: Column, stale: Column) -> Column:
    """The names of the thresholds that a report passes, in order."""
    named = {
        "mostly_undecided": rate(undecided, debates) > UNDECIDED_SHARE,
        "at_max_escalation": at_max > 0,
        "reviews_without_action": no_action_rate > NO_ACTION_SHARE,
        "stale_entries": stale > 0,
    }
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())), lambda x: x.isNotNull())


def distinct_definitions(definitions: Column) -> Column:
    """An entry's definitions (text, context_id) without those that repeat an earlier one of their frame but for white
    space; blank ones all stay, in order."""
    text = lambda d: stripped(F.regexp_replace(F.coalesce(d["text"], F.lit("")), r"(?U)\s+", " "))
    key = lambda d: F.struct(text(d).alias("text"), F.coalesce(d["context_id"], F.lit("")).alias("frame"), d["context_id"].isNull().alias("none"))
    keys = F.transform(definitions, lambda d: key(d))
    return F.filter(definitions, lambda d, i: (text(d) == "") | (F.array_position(keys, key(d)) == i + 1))


def deduplicated(entries: DataFrame) -> DataFrame:
    """entries (definitions; all columns are kept) with distinct definitions, and removed: how many went."""
    kept = entries.withColumn("__kept", distinct_definitions(F.col("definitions")))
    removed = F.coalesce(F.size("definitions") - F.size("__kept"), F.lit(0))
    return kept.withColumn("removed", removed).withColumn("definitions", F.col("__kept")).drop("__kept")
