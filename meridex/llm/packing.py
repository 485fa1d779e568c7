"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bulk-synchronous best fit, longest pieces first. Every superstep takes the pieces of one length, matches all of them at
once with the gaps that follow that length in sorted order (the successor: the smallest gap that holds them), gives the
k-th piece the k-th place (ranks resolve all conflicts), and updates the gaps. Pieces and gaps are sorted by size; a
size is a whole number from 1 to the capacity, so both sorted lists are kept as runs of equal size. The sweep is over
runs: its size follows the capacity (some thousands), never the corpus, and it gives what a sweep over rows would. What
grows with the corpus (token ids, ranks within a length, places) is computed on the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, written
from .tokens import chunk_tokenizer, sub_batches, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked in so many hash buckets, so that a frequent length isn't one task's.
RANK_BUCKETS = 256


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: a document's ids, then end_id, cut where longer than capacity.

    A null text counts as empty, which gives the end id alone; rows that repeat a doc_id are documents of their own.
    """
    path = tokenizer or tokenizer_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path)
        tail = np.array([end_id], "<u4")
        for batch in sub_batches(batches, 1):
            ids, offsets = tok.encode(batch.column(1))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a + 1
                if n <= capacity:
                    rows.append((doc, 0, 0, n, zlib.crc32(tail, zlib.crc32(ids[a:b]))))
                    continue
                own = np.concatenate((ids[a:b], tail))
                rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(own[s : s + capacity])) for k, s in enumerate(range(0, n, capacity))]
            doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(giving_back(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Where the pieces of each length go: those of rank first to first + count - 1 stand per_sequence to a sequence from
    sequence on, the first at offset. Sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    per_sequence: np.ndarray
    sequences: int


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Supersteps of best fit over runs of equal sizes; counts: pieces by length."""
    gaps: list[int] = []  # the sizes of open gaps, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, how many)
    made: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)  # the successor of this length among the gaps
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:  # no gap holds it: open as many sequences as these pieces fill
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            used = min(n, -(-left // each))
            take = min(left, used * each)
            made.append((length, rank, first, capacity - gap, each))
            full, part = divmod(take, each)
            put(gap - each * length, first, full)
            put(gap - part * length, first + full, int(part > 0))
            put(gap, first + used, n - used)
            rank += take
            left -= take
    made.sort(key=lambda x: (x[0], x[1]))
    return Plan(*(np.array([x[i] for x in made], np.int64) for i in range(5)), sequences=opened)


def ranked(pieces: DataFrame, label: str = "ranked") -> DataFrame:
    """pieces with rank (from 0, within their length, no gaps): ranks in a hash bucket of a length, and the pieces in the
    buckets before it, at most RANK_BUCKETS counts a length."""
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int"))
    before = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (see token_pieces).

    An empty table gives an empty result. Columns other than doc_id and the text are ignored.
    """
    pieces = written(token_pieces(docs, capacity, end_id, tokenizer, text), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = plan_best_fit(counts, capacity)
    shift = 44  # ranks stay below 2 ** 44
    keys = (plan.length << shift) + plan.first
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            nth = rank - plan.first[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(plan.sequence[at] + nth // plan.per_sequence[at]), pa.array(plan.offset[at] + nth % plan.per_sequence[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
