"""Cosine shortlists of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that the queries are dealt into: a task compares one block of queries with one part of the stored vectors.
QUERY_BLOCKS = 8
#: Fixed value: candidates a shortlist has.
SHORTLIST = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones, nulls, and where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def shortlist(queries: DataFrame, stored: DataFrame, k: int = SHORTLIST, digits: int = 6, blocks: int = QUERY_BLOCKS, parts: int | None = None) -> DataFrame:
    """q, id, cosine, rank: for each of queries the k nearest of stored (both: id, language, model, embedding) in another
    language and of the same model and dimension; ties by id. A query without such a vector has no row.

    Both sides are dealt into blocks, every block of queries meets every part of the stored vectors in one task, which
    ranks k of its own before the parts are put together; neither side is broadcast, neither has to fit anywhere.
    """
    spark = stored.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = lambda df: df.select("id", "language", "model", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    normed = lambda df: plain(df).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    asked = normed(queries).select(F.col("id").alias("q"), F.col("language").alias("l"), F.col("model").alias("m"), F.col("v").alias("u"), F.col("norm").alias("s"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = normed(stored).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = own.join(asked, ["block", "part"]).where((F.col("l") != F.col("language")) & (F.col("m") == F.col("model")) & (F.size("u") == F.size("v")))
    scored = met.select("q", "id", "part", F.round(F.coalesce(F.try_divide(dot(F.col("u"), F.col("v")), F.col("s") * F.col("norm")), F.lit(0.0)), digits).alias("cosine"))
    near = Window.partitionBy("q", "part").orderBy(F.desc("cosine"), "id")
    some = scored.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k)
    last = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("q", "id", "cosine", "rank")
