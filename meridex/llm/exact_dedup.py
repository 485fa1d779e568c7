"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. A batch is reduced to one row a digest,
anti-joined with the index by sort-merge join (the index side needs neither shuffle nor, after one append, sort), and
what is new is appended. JVM-side throughout.

Defined cases: null text counts as empty; runs of ASCII white space count as one space; a null doc_id loses against
any other; of rows that repeat both doc_id and text one stays; an empty table gives an empty result; other columns are
ignored, whatever their names. The index knows the batch that brought a digest: a batch that is given again, after a
failure say, gives the same result again, and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, join_groups, scratch_path, written

SPACES = r"[\x20\x09-\x0D]+"


def text_digest(text: str = "text"):
    """SHA-256 of the text with white space normalised, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, self.name)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of groups (digest, keep_id, batch) that the index lacks."""
        new = groups.select("digest", "keep_id", "batch").join(self.table().hint("merge"), "digest", "left_anti")
        # computed before the append, as a table can't be read while it is written
        new = written(new, "new-digests")
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        dropped(new)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """One sorted file a bucket again, after many appends."""
        old = written(self.table(), "compact")
        old.repartition(self.buckets, "digest").write.insertInto(self.name, overwrite=True)
        dropped(old)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per document of docs (a batch): doc_id, keep_id, group_size, kept, text_sha256.

    A digest that the index already had keeps the document it was first seen with, so that none of the batch is kept;
    of a new digest the smallest doc_id stays. The batch's new digests are in the index when this returns. batch: the
    batch's name; by default it is made from the batch's ids and digests, so that equal batches have one name.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    # a row per document and text, so that repeated rows can be told apart by number; no key is hot here
    rows = written(docs.select(F.col("doc_id").cast("long"), text_digest(text).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("ids"))
    total, name = rows.agg(F.count(F.lit(1)), F.concat_ws("-", F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64("doc_id", "digest", "copies"))), F.hex(F.sum(F.xxhash64("digest", "doc_id").cast("decimal(38,0)")).cast("string")))).first()
    batch = batch or name
    known = index.table().select("digest", F.col("keep_id").alias("known_id"), (F.col("batch") != batch).alias("known")).hint("merge")
    groups = written(
        groups.join(known, "digest", "left").select(
            "digest", "group_size", "ids", F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("known_id")).otherwise(F.col("first_id")).alias("keep_id"), F.lit(batch).alias("batch")
        ),
        "digest-groups",
    )
    index.append(groups.where(~F.col("known")))
    joined = join_groups(rows, groups.drop("batch"), ["digest"], "ids", total)
    copy = F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array(F.lit(1).cast("long"))))
    return joined.withColumn("copy", copy).select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
