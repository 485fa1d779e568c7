"""Whether a revision that external evidence suggests replaces a definition: one row per opinion in, one per term out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the most cautious on. Fixed values.
RELATIONS = ("challenge", "irrelevant", "discriminate", "clarify", "enrich", "corroborate")


def decide_grounding(opinions: DataFrame, terms: DataFrame) -> DataFrame:
    """id, relation, outcome, confidence of every term that has an opinion.

    opinions: id, agent (critic, explorer, or any other for earlier turns), relation, confidence, faithful, definition.
    terms: id, corpus_definition, corpus_confidence, copied (the proposal repeats an external passage). An unknown
    relation counts as irrelevant, a null flag as false, a null confidence as 0. The first rule that holds decides.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation")), F.lit(0)), F.lit(2)).cast("int")
    said = lambda agent: F.max(F.when(F.col("agent") == agent, F.trim(F.coalesce("definition", F.lit("")))))
    each = opinions.groupBy("id").agg(
        F.min(rank).alias("rank"),
        F.max((rank == 2).cast("int")).alias("dismissed"),
        F.min(F.coalesce("faithful", F.lit(False)).cast("int")).alias("faithful"),
        F.min(F.coalesce("confidence", F.lit(0.0))).alias("least"),
        said("critic").alias("final"),
        said("explorer").alias("proposed"),
    )
    worded = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    outcome = (
        F.when(F.col("rank") == 1, "challenged")
        .when(F.trim(F.coalesce("corpus_definition", F.lit(""))) == "", "no_corpus_definition")
        .when((F.col("faithful") == 0) | (F.col("dismissed") == 1) | (F.coalesce("proposed", F.lit("")) == ""), "unchanged")
        .when(worded("final") != worded("proposed"), "not_ratified")
        .when(F.coalesce("copied", F.lit(False)), "copied")
        .when(F.col("least") < F.coalesce("corpus_confidence", F.lit(0.0)), "below_corpus")
        .otherwise("adopted")
    )
    decided = terms.join(each, "id").withColumn("outcome", outcome)
    confidence = F.when(F.col("outcome") == "challenged", F.least("corpus_confidence", "least")).when(F.col("outcome") == "adopted", F.col("least")).otherwise(F.col("corpus_confidence"))
    return decided.select("id", F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("rank")).alias("relation"), "outcome", confidence.alias("confidence"))
