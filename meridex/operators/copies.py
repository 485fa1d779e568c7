"""Verbatim copies: runs of words that documents share with other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Words of a run that counts as copied, and characters of a text that counts if it is contained.
RUN_WORDS, CONTAINED_CHARS = 8, 40


def shared_runs(docs: DataFrame, items: DataFrame, doc: str, item: str, n: int = RUN_WORDS) -> DataFrame:
    """doc, item, runs: how many different runs of n words a document shares with an item.

    Runs meet by 64-bit hash. Texts of fewer words and null texts have no runs. Spark broadcasts the items' hashes where it
    finds them small, or thins the documents' by a Bloom filter of the items' before they are shuffled.
    """
    # explode_outer, as Spark puts a filter on the array below an inner explode, which computes the array a second time
    rows = lambda df, k: X.shingle_hashes(df, "text", n, k).select(k, F.explode_outer("hs").alias("h")).where("h IS NOT NULL")
    left, right = rows(docs, doc), rows(items, item)
    return left.join(right, "h").groupBy(doc, item).agg(F.count(F.lit(1)).alias("runs"))


def folded(text: Column) -> Column:
    """Trimmed, white space single, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def bare_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def copied(pairs: DataFrame, own: str = "definition", other: str = "passage", n: int = RUN_WORDS) -> DataFrame:
    """pairs, and copied: whether own repeats other verbatim. Equal as folded text or as words; the shorter of at least
    CONTAINED_CHARS characters lies in the other; or both share a run of n words. Empty texts copy nothing."""
    rows = pairs.withColumn("__a", folded(F.col(own))).withColumn("__b", folded(F.col(other))).withColumn("__u", bare_words(F.col(own))).withColumn("__v", bare_words(F.col(other)))
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    short, long = F.when(F.length("__a") <= F.length("__b"), F.col("__a")).otherwise(F.col("__b")), F.when(F.length("__a") <= F.length("__b"), F.col("__b")).otherwise(F.col("__a"))
    inside = (F.length(short) >= CONTAINED_CHARS) & F.contains(long, short)
    same = (F.col("__a") == F.col("__b")) | ((F.size("__u") > 0) & (F.col("__u") == F.col("__v")))
    hit = (F.col("__a") != "") & (F.col("__b") != "") & (same | inside | F.arrays_overlap(grams(F.col("__u")), grams(F.col("__v"))))
    return rows.withColumn("copied", hit).drop("__a", "__b", "__u", "__v")
