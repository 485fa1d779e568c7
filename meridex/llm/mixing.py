"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected (by 32nds, so that
a few passes over the source table do) to meet a target entropy of the weights or, without one, to be the flattest that
repeats no source more than max_repeats times. A source's quota is its weight times the budget: whole passes over the
source, then a part of one more. Every pass is a permutation of its own, by a hash of the pass and the document, in
blocks of the hash's high bits; the last pass is cut in the one block in which the running sum of tokens reaches the
quota, so that a hot source is never one task's. Tokens are those of a public tokenizer.

Defined cases: a null source is a source; a null text has no tokens; sources without tokens get weight 0 and none of their
rows; rows that repeat doc_id and text keep each other's company in a pass; an empty table, or a budget of 0, gives an
empty result; a negative budget, an entropy that no exponent from 0 to 8 gives, and a budget that repeats the sources more
than max_repeats times even in proportion to their tokens are errors; other columns are passed through, whatever their
names, but for those named epoch and place, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, giving_back, join_groups, written
from .tokens import chunk_tokenizer, sub_batches, tokenizer_path

MAX_REPEATS = 4.0
STEPS, PASSES = 32, 4
MAX_EXPONENT = 8.0
BLOCK_BITS = 10


def token_counts(rows: DataFrame, text: str, tokenizer: str | None = None) -> DataFrame:
    """rows with tokens (long) in place of the text."""
    path = tokenizer or tokenizer_path()
    at = rows.columns.index(text)
    names = [c for c in rows.columns if c != text]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path)
        for batch in sub_batches(batches, at):
            _, ends = tok.encode(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(np.diff(ends).astype(np.int64))], [*names, "tokens"])

    return rows.mapInArrow(giving_back(run), f"{schema}, tokens long")


def find_exponent(sources: DataFrame, total: int, budget: float, target_entropy: float | None, max_repeats: float) -> tuple[float, float]:
    """The exponent and the sum of all shares to its power; sources: one row each, with its tokens."""
    share = F.col("tokens") / F.lit(float(total))
    if target_entropy is None and budget > max_repeats * total * (1 + 1e-9):
        raise ValueError(f"a budget of {budget:.0f} tokens repeats {total} more than {max_repeats} times")
    low, high = 0.0, 1.0 if target_entropy is None else MAX_EXPONENT
    best = (high, 1.0)
    for p in range(PASSES):
        tries = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        sums = sources.where("tokens > 0").agg(*(F.sum(F.pow(share, F.lit(a))) for a in tries), *(F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in tries), F.min(share)).first()
        z, zl, least = sums[: STEPS + 1], sums[STEPS + 1 : -1], sums[-1]
        entropy = [math.log(s) - a * sl / s for a, s, sl in zip(tries, z, zl, strict=True)]
        if target_entropy is None:  # the smallest source is repeated most
            fits = [least**a / s * budget / (least * total) <= max_repeats * (1 + 1e-9) for a, s in zip(tries, z, strict=True)]
        else:  # entropy falls as the exponent grows
            fits = [e <= target_entropy for e in entropy]
            if p == 0 and not entropy[-1] - 1e-9 <= target_entropy <= entropy[0] + 1e-9:
                raise ValueError(f"an entropy of {target_entropy} isn't between {entropy[-1]:.4f} and {entropy[0]:.4f}")
        i = fits.index(True) if True in fits else STEPS
        best = (tries[i], z[i])
        low, high = tries[max(i - 1, 0)], tries[i]
        if low == high:
            break
    return best


def _order(epoch: Column, doc: str, h: str) -> Column:
    """The place of a document in a pass."""
    return F.xxhash64(F.lit("mix"), epoch.cast("long"), F.col(doc), F.col(h))


def _block(order: Column) -> Column:
    return F.shiftright(order, 64 - BLOCK_BITS)


def mix_sources(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, text: str = "text", source: str = "source", tokenizer: str | None = None) -> DataFrame:
    """The rows of docs that the mixture takes, once per pass: all columns, epoch (int, from 1) and place (long; the
    documents of a pass in order of their places are its permutation). budget: tokens, by default as many as docs has."""
    if budget is not None and budget < 0:
        raise ValueError("a budget can't be negative")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    h = F.xxhash64(F.col(text))
    others = [c for c in docs.columns if c.lower() not in ("epoch", "place")]
    nothing = docs.select(*(F.col(f"`{c}`") for c in others), F.lit(1).alias("epoch"), F.lit(0).cast("long").alias("place")).limit(0)
    rows = docs.select(name.alias("key"), F.col("doc_id").cast("long").alias("doc"), h.alias("h"), F.col(text).alias("body"))
    slim = written(token_counts(rows, "body", tokenizer), "mix-rows")
    sources = written(slim.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    total, count = sources.agg(F.sum("tokens"), F.sum("docs")).first()
    budget = total if budget is None else budget
    if not total or not budget:
        dropped(slim, sources)
        return nothing
    exponent, z = find_exponent(sources, total, float(budget), target_entropy, max_repeats)
    quota = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z) * F.lit(float(budget))
    quotas = sources.where("tokens > 0").withColumn("quota", quota).withColumn("full", F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9)))
    quotas = written(quotas.withColumn("rest", F.greatest(F.col("quota") - F.col("full") * F.col("tokens"), F.lit(0.0))).select("key", "docs", "full", "rest"), "mix-quotas")
    # the last pass: in the order of its own permutation, blocks first, then the rows of the block that reaches the quota
    last = join_groups(slim, quotas, ["key"], "docs", count).withColumn("order", _order(F.col("full") + 1, "doc", "h"))
    last = written(last.select("key", "order", _block(F.col("order")).alias("block"), "tokens"), "mix-last-pass")
    sums = last.groupBy("key", "block").agg(F.sum("tokens").alias("n"))
    sums = sums.withColumn("after", F.sum("n").over(Window.partitionBy("key").orderBy("block"))).withColumn("before", F.col("after") - F.col("n"))
    edge = written(sums.join(quotas, "key").where((F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest"))).select("key", "block", "before", "rest"), "mix-edges")
    run = F.sum("tokens").over(Window.partitionBy("key", "block").orderBy("order"))
    cut = last.join(edge, ["key", "block"]).withColumn("run", F.col("before") + run).where(F.col("run") <= F.col("rest")).groupBy("key").agg(F.max("order").alias("cut"))
    cuts = written(quotas.join(edge.select("key", "block"), "key", "left").join(cut, "key", "left"), "mix-cuts")
    dropped(slim, sources, quotas, last, edge)

    mine = fresh(docs, "mix_key", "mix_docs", "mix_full", "mix_rest", "mix_block", "mix_cut", "mix_doc", "mix_h", "mix_epoch", "mix_place")
    key, size, full, _, block, top, doc, digest, epoch, place = mine
    cuts = cuts.select(*(F.col(a).alias(b) for a, b in zip(("key", "docs", "full", "rest", "block", "cut"), mine, strict=False)))
    keyed = docs.withColumn(key, name).withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, h)
    taken = join_groups(keyed, cuts, [key], size, count)
    order = _order(F.col(full) + 1, doc, digest)
    part = (_block(order) < F.col(block)) | ((_block(order) == F.col(block)) & F.coalesce(order <= F.col(top), F.lit(False)))
    passes = (F.col(full) + F.coalesce(part, F.lit(False)).cast("long")).cast("int")
    each = taken.withColumn(epoch, passes).where(F.col(epoch) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(epoch))))
    each = each.withColumn(place, _order(F.col(epoch), doc, digest))
    return each.select(*(F.col(f"`{c}`") for c in others), F.col(epoch).alias("epoch"), F.col(place).alias("place"))
