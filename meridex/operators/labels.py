"""The next free labels: smallest unused numbers and letters, found among what follows a used one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def _refused(bad: Column, message: str, otherwise: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(otherwise)


def _first_free(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """key, n of wanted (key): the smallest number from 1 on that used (key, n) lacks. It is 1 or follows a used one."""
    after = used.select("key", (F.col("n") + 1).alias("n")).unionByName(wanted.select("key", F.lit(1).alias("n")))
    return after.distinct().join(used.distinct(), ["key", "n"], "left_anti").groupBy("key").agg(F.min("n").alias("n")).join(wanted.select("key").distinct(), "key", "left_semi")


def next_top_level(labels: DataFrame) -> DataFrame:
    """label: the next free top-level one, given labels (label). Variants, deeper and malformed labels don't count."""
    spark = labels.sparkSession
    top = labels.where((L.depth(F.col("label")) == 1) & L.suffix(F.col("label")).isNull())
    used = top.select(F.lit("").alias("key"), L.segments(F.col("label"))[0].alias("n"))
    free = _first_free(spark.range(1).select(F.lit("").alias("key")), used)
    return free.select(_refused(F.col("n") > L.MAX_NUMBER, "no top-level number is free", L.formed(F.array("n"))).alias("label"))


def next_child(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """parent, label: the next free label under each of parents (parent). A variant, a malformed label or one of the
    greatest depth as parent is an error, and so is a parent without a free number."""
    key = F.col("parent")
    bad = ~L.is_valid(key) | L.suffix(key).isNotNull() | (L.depth(key) >= L.MAX_DEPTH)
    wanted = parents.select(_refused(bad, "no child can be under this label", key).alias("key")).distinct()
    kids = labels.where(L.is_valid(F.col("label")) & L.suffix(F.col("label")).isNull() & (L.depth(F.col("label")) > 1))
    used = kids.select(L.parent(F.col("label")).alias("key"), F.element_at(L.segments(F.col("label")), -1).alias("n"))
    child = L.formed(F.concat(L.segments(F.col("key")), F.array("n")))
    return _first_free(wanted, used).select(F.col("key").alias("parent"), _refused(F.col("n") > L.MAX_NUMBER, "no child number is free", child).alias("label"))


def next_variant(bases: DataFrame, labels: DataFrame) -> DataFrame:
    """base, label: the next free variant, a to z, of each of bases (base); a variant as base is an error."""
    key = F.col("base")
    wanted = bases.select(_refused(~L.is_valid(key) | L.suffix(key).isNotNull(), "no variant can be of this label", key).alias("key")).distinct()
    own = labels.where(L.suffix(F.col("label")).isNotNull())
    used = own.select(L.parent(F.col("label")).alias("key"), (F.ascii(L.suffix(F.col("label"))) - 96).alias("n"))
    return _first_free(wanted, used).select(F.col("key").alias("base"), _refused(F.col("n") > 26, "no variant letter is free", F.concat(F.col("key"), F.char(F.col("n") + 96))).alias("label"))
