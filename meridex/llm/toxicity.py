"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Training uses a bounded sample of the labelled rows: at most MAX_ROWS rows and MAX_CHARS characters, in the order of a
hash of doc_id, so that the sample is the same wherever the rows lie; a text that doesn't fit any more is passed over. A
feature is a hashed character n-gram (a space at either end of a word belongs to it), its value is whether the text has
it, times the log ratio of the n-gram's smoothed document rates under both labels. Logistic regression with an L2
penalty weighs the scaled features. The n-grams are hashed and counted where the texts lie; what reaches the driver are the
counts of all 2 ** BITS cells and the weights. One executor task fits the (bounded) sample from the features that count.
Scoring streams whole texts through the executors.

Defined cases: a null text counts as empty and gets the score of no features; rows without a label aren't trained on;
a null label is none; if only one label occurs, every score is that label's smoothed rate; with no labelled row at all
every score is 0, so that nothing is rejected; rows that repeat doc_id and text are learned from once; an empty table
gives an empty result; columns other than doc_id, text and toxic are passed through by score and drop_toxic, whatever
their names, but for one with the name of the score, which score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, giving_back, written

#: The bound of the training sample.
MAX_ROWS, MAX_CHARS = 8_000, 30_000_000
NGRAMS = (5,)
BITS = 20
#: Counts travel in blocks of so many cells.
BLOCK_BITS = 16
THRESHOLD = 0.3
#: An n-gram counts if so many training texts have it and its log ratio is that far from 0.
MIN_TEXTS, MIN_RATIO = 5, 1.0


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of doc_id as text is 2 modulo 4 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-case text, white space as one space, a space at either end."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)


def feature_ids(codes: np.ndarray, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS) -> np.ndarray:
    """The hashed n-gram that starts at each place, for all n; not across a text's end. Not distinct."""
    out = []
    for n in ngrams:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            h ^= codes[k : k + m]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Weights by hashed n-gram, those that aren't 0 (ids ascending)."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def score_of(text: str | None, weight: np.ndarray, bias: float) -> float:
    ids = feature_ids(_codes(text))
    hits = ids[weight[ids] != 0]
    z = bias + float(weight[np.unique(hits)].sum())
    return 1 / (1 + np.exp(-min(max(z, -40), 40)))


def unlearned(labels: np.ndarray) -> Model:
    """The model of labels alone: their smoothed rate, or 0 where there are none."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(rate / (1 - rate))) if len(labels) else -40.0)


def ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """By feature, the log ratio of its smoothed rates under label 1 and 0, or 0 where it doesn't count. counts: texts with
    the feature by label; texts: all texts by label."""
    ratio = np.log((counts[1] + 0.5) / (texts[1] + 1) / ((counts[0] + 0.5) / (texts[0] + 1))).astype(np.float32)
    ratio[(np.abs(ratio) < MIN_RATIO) | (counts[0] + counts[1] < MIN_TEXTS)] = 0
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias. rows: the features of each text, as places in r, their ratios."""
    y = labels.astype(np.float32)
    column, row = np.concatenate(rows), np.repeat(np.arange(len(y), dtype=np.int32), [len(k) for k in rows])
    value = r[column]
    # Adam on the scaled features
    rate = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(len(r)), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w.astype(np.float32)[column] * value, minlength=len(y)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(column, weights=e.astype(np.float32)[row] * value, minlength=len(r)) + l2 * w, e.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w * r, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, text, label of the sample: at most max_rows texts, of at most max_chars characters together. Only ids and
    lengths of as many candidates reach the driver."""
    marks = labels.where(F.col(label).isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = marks.where(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))  # max_rows rows at most
    sized = rows.groupBy("doc_id", "h").agg(F.max(F.char_length("text").cast("long")).alias("n")).orderBy(order, "doc_id", "n", "h").limit(max_rows)
    taken, chars = [], 0
    for r in sized.collect():
        if chars + r["n"] <= max_chars:
            chars += r["n"]
            taken.append((r["doc_id"], r["h"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, h long"))
    return rows.join(wanted, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    spark = docs.sparkSession
    size, blocks = 1 << BITS, 1 << (BITS - BLOCK_BITS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros((2, size), "<i4"), [0, 0]
        for batch in batches:
            for t, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found[int(label > 0)][feature_ids(_codes(t.as_py()))] += 1  # once a text, however often the text has it
                texts[int(label > 0)] += 1
        if sum(texts):
            parts = [*(found[:, k << BLOCK_BITS : (k + 1) << BLOCK_BITS].tobytes() for k in range(blocks)), np.array(texts, "<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), "<i4")
                total[k] = total[k] + own if k in total else own
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "counts"])

    sample = written(training_rows(docs, labels, **how), "training-rows")
    sums = {r["block"]: np.frombuffer(r["counts"], "<i4") for r in sample.mapInArrow(giving_back(counted), "block int, counts binary").repartition(blocks, "block").mapInArrow(giving_back(added), "block int, counts binary").toLocalIterator()}
    if not sums:
        dropped(sample)
        return unlearned(np.zeros(0))
    texts = sums.pop(blocks)
    ratio = ratios(np.concatenate([sums.pop(k).reshape(2, -1) for k in range(blocks)], axis=1), texts)
    used = np.flatnonzero(ratio).astype(np.int32)
    if not texts.min() or not len(used):
        dropped(sample)
        return unlearned(np.repeat([0, 1], texts))
    sent = spark.sparkContext.broadcast((used, ratio[used]))  # 8 MB at most, whatever the input

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(size, -1, np.int32)
        place[sent.value[0]] = np.arange(len(sent.value[0]), dtype=np.int32)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                k = place[feature_ids(_codes(t.as_py()))]
                rows.append(np.unique(k[k >= 0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x > 0) for x in batch.column(2).to_pylist()], pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            marks += batch.column(1).to_pylist()
            rows += [np.frombuffer(x.as_py(), "<i4") for x in batch.column(2)]
        if rows:
            weights, bias = fit(rows, np.array(marks), sent.value[1])
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    # the sample is bounded, so that one task can hold the features that count; its order doesn't change with the partitions
    rows = sample.mapInArrow(giving_back(placed), "doc_id long, label int, features binary").repartition(1).sortWithinPartitions("doc_id", "features")
    model = rows.mapInArrow(giving_back(fitted), "weights binary, bias double").first()
    dropped(sample)
    weights = np.frombuffer(model["weights"], "<f4")
    big = np.abs(weights) >= 1e-3
    return Model(used[big], weights[big], model["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of docs, and the score (double, 0 to 1) as name; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.ids, model.weights, model.bias))  # 8 MB at most, whatever the input
    docs = docs.drop(name)
    fields = docs.columns
    at = fields.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        weight = own.dense()
        for batch in batches:
            got = pa.array([score_of(t.as_py(), weight, own.bias) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*fields, name])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents of docs, all columns, that score below the threshold; all of them where no row is labelled."""
    return score(docs, train(docs, labels, text=text), text, "__toxicity").where(F.col("__toxicity") < threshold).select(*docs.columns)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
