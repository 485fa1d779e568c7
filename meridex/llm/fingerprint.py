"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its white-space separated words, each with its number of occurrences. For sample k a word
has r and c from Gamma(2, 1) and b from U(0, 1), all drawn by hash from the word and k. With weight w its step is
t = floor(ln w / r + b) and its value ln c - r * (t + 1 - b); the sample is the (word, t) of least value. Two documents
agree in a sample with the probability of their generalised Jaccard similarity, sum of min(w) / sum of max(w).

JVM-side throughout. A value and its sample travel as one long, the value (its logarithm, in 31 bits) in the high half and
a hash of word and step in the low half, so that a sample is a plain minimum. Words are counted where their document
lies (the table of edited texts is bucketed by document), so no word is shuffled.

Defined cases: a null text counts as empty; a text without words has the fingerprint of all ones, like all such texts;
a null doc_id comes after all others in descending order; of rows that share the next doc_id the one with the smallest
XXH64 of id and text is the next document; repeated rows are each returned; an empty table gives an empty result; columns
other than doc_id and the text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, scratch_path, written

SAMPLES = 64
#: Samples that one row of the aggregation computes; its generated code must stay small enough to be compiled.
AT_ONCE = 2
SPACES = r"[\x20\x09-\x0D]+"
NONE = (1 << 63) - 1
LOWEST = -(1 << 63)


def _bits(h: str, shift: int, width: int) -> str:
    """So many bits of a hash, as a number above 0; 2 ** -width times it is a draw from U(0, 1). Scaled by a product, as
    Spark checks every divisor."""
    return f"((shiftrightunsigned({h}, {shift}) & {(1 << width) - 1}L) + 0.5D)"


def weighted_samples(terms: DataFrame, keys: list[str], marks: list[str], samples: int = SAMPLES) -> DataFrame:
    """terms (keys, term long, weight double, and for each of marks a boolean: whether the term counts there) to keys and,
    for each of marks, an array of longs: the sampled (value, word and step), NONE where nothing counts."""
    each = range(AT_ONCE)
    rows = terms.select(*keys, "term", F.log("weight").alias("ln_w"), *(F.when(F.col(m), F.lit(0).cast("long")).otherwise(F.lit(NONE)).alias(m) for m in marks))
    rows = rows.withColumn("block", F.explode(F.array(*(F.lit(k) for k in range(0, samples, AT_ONCE)))))
    rows = rows.select(*keys, "block", "ln_w", *marks, *(F.xxhash64("term", F.col("block") + j).alias(f"g{j}") for j in each))
    rows = rows.select("*", *(F.xxhash64(f"g{j}").alias(f"h{j}") for j in each))
    gamma = "-ln({} * {} * {!r}D)"
    drawn = {f"r{j}": gamma.format(_bits(f"g{j}", 0, 21), _bits(f"g{j}", 21, 21), 2.0**-42) for j in each}
    drawn |= {f"b{j}": f"{_bits(f'g{j}', 42, 22)} * {2.0**-22!r}D" for j in each}
    drawn |= {f"c{j}": "ln(" + gamma.format(_bits(f"h{j}", 0, 32), _bits(f"h{j}", 32, 32), 2.0**-64) + ")" for j in each}
    rows = rows.select(*keys, "block", "ln_w", *marks, *(f"h{j}" for j in each), *(F.expr(e).alias(n) for n, e in drawn.items()))
    rows = rows.select("*", *(F.expr(f"floor(ln_w / r{j} + b{j})").alias(f"t{j}") for j in each))
    value = "shiftleft(cast((c{0} - r{0} * (t{0} + 1 - b{0}) + 128D) * 8388608D as long), 32) | ((h{0} ^ t{0}) & 4294967295L)"
    rows = rows.select(*keys, "block", *marks, *(F.expr(value.format(j)).alias(f"v{j}") for j in each))
    least = rows.groupBy(*keys, "block").agg(*(F.min(F.col(f"v{j}").bitwiseOR(F.col(m))).alias(f"{m}{j}") for m in marks for j in each))
    out = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *(F.array(*(f"{m}{j}" for j in each)).alias(m) for m in marks)))).alias("x"))
    return out.select(*keys, *(F.flatten(F.col("x").getField(m)).alias(m) for m in marks))


def next_ids(ids: DataFrame) -> DataFrame:
    """did, next_did, n of ids (did, n; each did once): the next lower did, and for the lowest the highest."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(ids.repartitionByRange(n, "did").withColumn("slice", F.spark_partition_id()), "ids")
    inside = placed.withColumn("next_did", F.lead("did").over(Window.partitionBy("slice").orderBy(F.desc("did"))))
    top = placed.groupBy("slice").agg(F.max("did").alias("top"))  # one row a range partition
    whole = Window.orderBy("slice")
    below = top.select("slice", F.coalesce(F.lag("top").over(whole), F.max("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    return inside.join(F.broadcast(below), "slice").select("did", "n", F.coalesce("next_did", "below").alias("next_did"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))


def hex_of(signature: str) -> Column:
    return F.concat_ws("", F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))))


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.groupBy("did").agg(F.max(F.char_length("text")).alias("n"))
    follow = written(next_ids(ids), "next-ids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(buckets, "did")
    wanted = follow.select(F.col("next_did").alias("did"), F.col("did").alias("for_did"), F.expr("cast(n div 3 as int)").alias("need"))
    heads = dealt.join(wanted, "did").select("for_did", F.xxhash64("did", "text").alias("h"), F.expr("left(text, need)").alias("head"))
    heads = heads.groupBy(F.col("for_did").alias("did")).agg(F.min_by("head", "h").alias("head"))
    edited = dealt.join(heads, "did").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("k", F.expr("cast(n_chars div 3 as int)"))
    edited = edited.withColumn("kept", F.expr("left(text, cast(n_chars as int) - k)")).withColumn("cut", F.expr("substring(text, cast(n_chars as int) - k + 1)")).withColumn("put", F.expr("left(head, k)"))
    edited = edited.select("did", F.monotonically_increasing_id().alias("rid"), F.xxhash64("did", "text").alias("h"), "n_chars", F.sha2(F.concat("kept", "put"), 256).alias("edited_sha256"), "kept", "cut", "put")
    name = f"edited_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    edited.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "did").saveAsTable(name)
    edited = spark.table(name)

    texts = F.explode(F.array(F.struct(F.lit(0).alias("other"), F.concat("kept", "cut").alias("t")), F.struct(F.lit(1).alias("other"), F.concat("kept", "put").alias("t"))))
    words = edited.select("did", "rid", texts.alias("x")).select("did", "rid", "x.other", F.explode(F.split("x.t", SPACES)).alias("word")).where("word <> ''")
    counts = words.groupBy("did", "rid", F.xxhash64("word").alias("term")).agg(F.sum(1 - F.col("other")).alias("own"), F.sum("other").alias("new"))
    # a word of equal weight in both texts is one row, of different weights two
    row = lambda w, a, b: F.struct(F.col(w).alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    rows = F.explode(F.when(F.col("own") == F.col("new"), F.array(row("own", True, True))).otherwise(F.array(row("own", True, False), row("new", False, True))))
    terms = counts.withColumn("x", rows).select("did", "rid", "term", F.col("x.w").cast("double").alias("weight"), F.col("x.a").alias("own"), F.col("x.b").alias("new")).where("weight > 0")
    signatures = weighted_samples(terms, ["did", "rid"], ["own", "new"], samples)
    empty = F.array_repeat(F.lit(NONE), samples)
    marked = edited.select("did", "rid", "h", "n_chars", "edited_sha256").join(signatures, ["did", "rid"], "left")
    marked = written(marked.withColumn("own", F.coalesce("own", empty)).withColumn("new", F.coalesce("new", empty)), "signatures")
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, path)
    following = marked.groupBy("did").agg(F.min_by("own", "h").alias("next")).withColumnRenamed("did", "next_did")
    out = marked.join(follow.select("did", "next_did"), "did").join(following, "next_did")
    return out.select(
        F.when(F.col("did") != LOWEST, F.col("did")).alias("doc_id"), "n_chars", "edited_sha256", hex_of("own").alias("fingerprint"), hex_of("new").alias("edited_fingerprint"), likeness("own", "new", samples).alias("near_edited"), likeness("own", "next", samples).alias("near_next")
    )
