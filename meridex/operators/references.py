"""References between entries: labels that definitions name, and terms of other entries that they use.

Terms meet texts in an equality join on one word: the longest word of a term is a whole word of every text that has the
term at word boundaries. Only pairs that have that word are tried with the whole term.

entries: label, canonical_term, texts (array of the definitions' texts). Null terms and texts give no references; of
entries with the same folded term the one with the least label is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Fixed value: shorter terms aren't looked for.
MIN_TERM = 4
WORD = r"(?U)\w+"


def bounded(term: Column) -> Column:
    """A pattern for the term as it is, at word boundaries."""
    return F.concat(F.lit(r"(?U)\b\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def ontology_index(entries: DataFrame) -> DataFrame:
    """term (lower case), target (label)."""
    return entries.where("canonical_term <> ''").groupBy(F.lower("canonical_term").alias("term")).agg(F.min("label").alias("target"))


def semantic_references(texts: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """keys, target: which terms of index (term, target) the texts (keys, text) use, each once a row of texts."""
    words = F.regexp_extract_all("term", F.lit(WORD), F.lit(0))
    longest = F.reduce(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    terms = index.where(F.length("term") >= MIN_TERM).withColumn("word", longest).where("word <> ''")
    rows = texts.where("text IS NOT NULL").select(*keys, F.lower("text").alias("text"))
    # words first, so that a text travels only with the words that some term has
    split = rows.select(*keys, "text", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")).where("word IS NOT NULL")
    return split.join(terms, "word").where(F.regexp_like("text", bounded(F.col("term")))).select(*keys, "target").distinct()


def computed(entries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """label, refs of every entry: definition by definition the labels that it names, in order, then those whose terms it
    uses, in order of label; each once, the entry itself never."""
    index = ontology_index(entries) if index is None else index
    texts = entries.select("label", F.posexplode("texts").alias("nth", "text"))
    named = texts.select("label", "nth", F.lit(0).alias("kind"), F.posexplode(L.mentions(F.col("text"))).alias("at", "target"))
    used = semantic_references(texts, index, "label", "nth").select("label", "nth", F.lit(1).alias("kind"), F.lit(0).alias("at"), "target")
    first = named.unionByName(used).where("target <> label").groupBy("label", "target").agg(F.min(F.struct("nth", "kind", "at", "target")).alias("place"))
    lists = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list("place")), lambda p: p["target"]).alias("refs"))
    return entries.select("label").join(lists, "label", "left").select("label", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def updated(entries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """entries with references_labels computed anew, and changed (boolean)."""
    out = entries.join(computed(entries, index), "label")
    return out.withColumn("changed", ~F.col("refs").eqNullSafe(F.col("references_labels"))).withColumn("references_labels", F.col("refs")).drop("refs")


def backfill_counts(entries: DataFrame) -> DataFrame:
    """scanned, updated, total_refs of computing all references anew."""
    return updated(entries).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("changed").alias("updated"), F.coalesce(F.sum(F.size("references_labels")), F.lit(0)).alias("total_refs"))


def retro_linked(entries: DataFrame, label: str) -> DataFrame:
    """The entries, computed anew, whose texts use the term of the entry label; none if it is shorter than MIN_TERM."""
    own = entries.where(F.col("label") == label).select(F.lower("canonical_term").alias("term"), F.col("label").alias("target"))
    hit = semantic_references(entries.where(F.col("label") != label).select("label", F.explode("texts").alias("text")), own, "label").select("label").distinct()
    return updated(entries).join(hit, "label", "left_semi")


def entries_referencing(entries: DataFrame, label: str) -> DataFrame:
    """The entries whose references have the label, by label."""
    return entries.where(F.array_contains("references_labels", label)).orderBy("label")
