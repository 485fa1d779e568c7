"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of a fingerprint are dealt into partitions, correlated bits together. Fingerprints that differ in at most r bits
differ in at most t_i bits in some partition i, for any thresholds t_i >= -1 whose sum is r - partitions + 1. The
thresholds, and the number of partitions, are chosen by dynamic programming over estimated candidate counts, which come
from the partitions' value counts over all fingerprints. Each fingerprint probes, in partition i, the values within t_i
bits of its own; candidates are verified on all bits.

Groups of any size stay linear: equal fingerprints are one row; every partition value has a leader, and fingerprints
linked to their leaders are united first; then only candidates that are not united yet are formed, by joining the
probes with those members of a value that lie outside its largest united set (and, for probes from outside that set,
with its members). Pairs within a united set are never formed, and no link that could unite two sets is left out.

Defined cases: a null text counts as empty; a text of fewer words than a shingle is one shingle; a text without words
has fingerprint zero and links like any other; rows that repeat a doc_id or have none are documents of their own; an
empty table gives an empty result; columns other than doc_id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back_on_driver, giving_back, join_groups, written
from .components import connected_components

SEED = 42
#: Weights of the plan's estimate: a probe row against a candidate row.
PROBE_COST, PAIR_COST = 1.0, 1.0


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of so many words, repeats included."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)], np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further independent bits of a hash; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, words: int, lanes: int = 1, block: int = 1 << 15) -> bytes:
    """64 * lanes bits, the first the most significant: a bit is one if it is in over half of the shingle hashes."""
    return simhash_of(shingle_hashes(text, words), lanes, block)


def simhash_of(h: np.ndarray, lanes: int = 1, block: int = 1 << 15) -> bytes:
    if not len(h):
        return bytes(8 * lanes)
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), block):
            part = _mixed(h[at : at + block], lane).astype(">u8").view(np.uint8)
            ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.uint32)
        out.append(np.packbits(ones * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int, bits: int = 64, text: str = "text") -> DataFrame:
    """doc_id, fp (array of bits / 64 longs)."""
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(simhash(t, words, lanes) for t in batch.column(1).to_pylist())
            values = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, lanes, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, fp array<long>")


def fingerprint_hex(fp: Column | str = "fp") -> Column:
    return F.lower(F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0"))))


def distance(a: Column, b: Column, lanes: int) -> Column:
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, lanes):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def part_value(fp: Column, part: list[int]) -> Column:
    """The bits of a partition as a number; neighbouring bits of one word are taken together."""
    runs: list[list[int]] = []
    for bit in part:
        if runs and bit == runs[-1][-1] + 1 and bit // 64 == runs[-1][0] // 64:
            runs[-1].append(bit)
        else:
            runs.append([bit])
    out, low = None, 0
    for run in reversed(runs):
        piece = F.shiftrightunsigned(fp[run[0] // 64], 63 - run[-1] % 64).bitwiseAND(F.lit((1 << len(run)) - 1))
        piece = F.shiftleft(piece, low) if low else piece
        out = piece if out is None else out.bitwiseOR(piece)
        low += len(run)
    return out


def bit_correlation(fps: DataFrame, bits: int) -> np.ndarray:
    """Absolute correlation of the bits over all fingerprints: each task sums its own, the sums are added up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((bits, bits)), 0
        for batch in batches:
            own = np.asarray(batch.column(0).flatten()).astype(">i8").view(np.uint8)
            x = np.unpackbits(own).reshape(-1, bits).astype(np.float32)
            both += x.T @ x
            n += len(x)
        rows = np.concatenate((both.ravel(), [n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # bits ** 2 + 1 rows
    values = np.zeros(bits * bits + 1)
    for r in cells:
        values[r["cell"]] = r["n"]
    n, both = max(values[-1], 1), values[:-1].reshape(bits, bits)
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def partitions(bits: int, parts: int, correlation: np.ndarray | None = None) -> list[list[int]]:
    """The bits in partitions of nearly equal width; with a correlation, each grows by the bit most correlated with it."""
    width = [bits // parts + (i < bits % parts) for i in range(parts)]
    if correlation is None:
        ends = np.cumsum([0, *width])
        return [list(range(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    free, out = set(range(bits)), []
    for w in width:
        first = max(sorted(free), key=lambda b: sum(correlation[b][x] for x in free) - correlation[b][b])
        part = [first]
        free.remove(first)
        while len(part) < w:
            best = max(sorted(free), key=lambda b: sum(correlation[b][x] for x in part))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def allocate(radius: int, widths: list[int], same: list[float], n: int, most: int = 4) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost whose sum is radius - partitions + 1, each from -1 (not probed) to most.

    same: by partition, the sum of squared value counts, so the candidates of threshold 0; a wider threshold is taken
    to meet as many a probe.
    """
    target = radius - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, pairs in zip(widths, same, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, min(most, width) + 1):
                c = cost + ball(width, t) * (PROBE_COST * n + PAIR_COST * pairs)
                if total + t not in step or c < step[total + t][0]:
                    step[total + t] = (c, [*chosen, t])
        best = step
    return best.get(target, (math.inf, []))


def plan(fps: DataFrame, bits: int, radius: int, parts: tuple[int, ...], correlate: bool = True) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of least estimated cost; fps: one row per distinct fingerprint."""
    correlation = bit_correlation(fps, bits) if correlate else None
    layouts = {m: partitions(bits, m, correlation) for m in parts}
    n = fps.count()
    keys = [(m, i) for m in parts for i in range(m)]
    if len(parts) == 1:  # nothing to choose between partition numbers: expected counts do
        m = parts[0]
        return layouts[m], allocate(radius, [len(p) for p in layouts[m]], [n * n / 2 ** len(p) for p in layouts[m]], n)[1]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), part_value(F.col("fp"), layouts[m][i]).alias("v")) for k, (m, i) in enumerate(keys))))
    counts = fps.select(values.alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    pairs = {keys[r["k"]]: r["pairs"] for r in counts.collect()}  # a row per partition
    found = {m: allocate(radius, [len(p) for p in layouts[m]], [pairs.get((m, i), 0.0) for i in range(m)], n) for m in parts}
    m = min(found, key=lambda x: found[x][0])
    return layouts[m], found[m][1]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def near_components(fps: DataFrame, lanes: int, max_distance: int, radius: int, parts: tuple[int, ...], correlate: bool = True) -> DataFrame:
    """node, root of the distinct fingerprints (fid, fp, docs) that have a link: at most max_distance bits differ."""
    return connected_components(near_links(fps, lanes, max_distance, radius, parts, correlate))


def near_links(fps: DataFrame, lanes: int, max_distance: int, radius: int, parts: tuple[int, ...], correlate: bool = True) -> DataFrame:
    """a, b of links between the distinct fingerprints (fid, fp, docs): at most max_distance bits differ. Enough of them to
    have the components of all links; those within a set that others unite are left out.

    Complete for links of at most radius bits; beyond it a link is found if some partition is within its threshold.
    Candidates are verified in the condition of the join that meets them, so that none but links is ever a row. Where only
    equal values meet, fingerprints are attached to the rows of values that several have, and to no others.
    """
    layout, thresholds = plan(fps, 64 * lanes, radius, parts, correlate)
    used = [(i, p, t) for i, (p, t) in enumerate(zip(layout, thresholds, strict=True)) if t >= 0]
    exact = not any(t for *_, t in used)
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), part_value(F.col("fp"), p).alias("value")) for i, p, _ in used)))
    key = ["part", "value"]
    members = written(fps.select("fid", "docs", values.alias("x")).select("x.part", "x.value", "fid", "docs"), "members")
    if exact:
        shared = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        narrow, members = members, members.join(shared, key)
    if lanes > 1:  # else the name is the fingerprint
        members = members.join(fps.select("fid", "fp"), "fid")
    if exact:
        members = written(members, "shared-members")
        dropped(narrow)
    own = ["fid", "fp"] if lanes > 1 else ["fid"]
    other = [F.col(c).alias(f"{c}2") for c in own]
    near = (distance(F.col("fp"), F.col("fp2"), lanes) if lanes > 1 else F.bit_count(F.col("fid").bitwiseXOR(F.col("fid2")))) <= max_distance

    def links_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("fid", "fid2").alias("a"), F.greatest("fid", "fid2").alias("b")).distinct()

    # links to the leader of each value, then the sets that they unite
    lead = members.groupBy(*key).agg(F.max_by(F.struct(*own), F.struct("docs", F.xxhash64("fid"))).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lead = lead.select(*key, *(F.col(f"lead.{c}").alias(f"{c}2") for c in own))
    star = written(links_of(members.join(lead, key).where((F.col("fid") != F.col("fid2")) & near)), "star")
    united = connected_components(star)

    # each member with its set; each value with its largest set
    placed = members.drop("docs").join(united.withColumnRenamed("node", "fid"), "fid", "left")
    members_in = written(placed.select(*key, *own, F.coalesce("root", "fid").alias("set")), "members")
    dropped(members)
    largest = members_in.groupBy(*key, "set").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("set", F.struct("n", "set")).alias("largest"), F.count(F.lit(1)).alias("sets"))
    if exact:  # a value whose members are all of one set has nothing more to link
        valued = probes = written(members_in.join(largest.where("sets > 1").drop("sets"), key), "valued")
    else:
        largest = largest.drop("sets")
        # a probe with its partition's masks; of two values that differ, the one with the lowest differing bit set probes
        by_part = F.create_map(*(x for i, p, t in used for x in (F.lit(i), F.array(*map(F.lit, _masks(len(p), t))))))
        probes = members_in.withColumn("mask", F.explode(by_part[F.col("part")])).where((F.col("mask") == 0) | (F.col("value").bitwiseAND(F.col("mask")).bitwiseAND(-F.col("mask")) != 0))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask").cast("long"))).drop("mask")
        probes = written(probes.join(largest, key), "probes")
        valued = written(members_in.join(largest, key), "valued")
    dropped(members_in)
    met = valued.select(*key, *other, F.col("set").alias("set2"), (F.col("set") == F.col("largest")).alias("inside"))
    apart = (F.col("set") != F.col("set2")) & near
    outer = F.col("set") != F.col("largest")
    found = links_of(probes.where(outer).join(met, key).where(apart))
    if not exact:  # a probe reaches values that don't probe back
        found = found.union(links_of(probes.where(~outer).join(met.where("NOT inside"), key).where(apart)))
    links = written(star.union(found), "links")
    dropped(probes, valued, star)
    return links


def near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 64, max_distance: int = 4, radius: int | None = None, parts: tuple[int, ...] = (2, 3, 4, 5), correlate: bool = True, text: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable over links of at most max_distance bits)."""
    lanes = bits // 64
    rows = written(fingerprints(docs, words, bits, text).withColumn("fid", F.col("fp")[0] if lanes == 1 else F.unhex(F.md5(fingerprint_hex().cast("binary")))), "fingerprints")
    fps = written(rows.groupBy("fid").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = near_components(fps, lanes, max_distance, max_distance if radius is None else radius, parts, correlate)
    known = fps.select("fid", "docs", "first_id").join(roots.withColumnRenamed("node", "fid"), "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    known = written(known, "roots")
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("fids"))
    classes = written(join_groups(known, smallest, ["root"], "fids", fps.count()).select("fid", "docs", "component_id"), "classes")
    return join_groups(rows.select("doc_id", "fid", "fp"), classes, ["fid"], "docs", rows.count()).select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


# The pipeline's near-duplicates: five-word shingle sets with a Jaccard similarity of 0.8 or more. SimHash fingerprints of these
# sets are searched as above, by correlated partitions and thresholds planned over measured counts, and the links found are
# checked on the whole sets. No radius reaches all pairs of that similarity (10 of 64 bits differ on average at 0.8), so what
# the search leaves apart is completed exactly by prefixes: in any one order of all shingles, sets of sizes n with that
# similarity share one of the first n - ceil(0.8 n) + 1 of each; these candidates are verified on the whole sets too, and only
# texts that aren't united yet are met. The order only decides how many candidates there are:
# shingles that many documents have are last. Each set also has a bitmap, of which a bit is one if an odd number of its
# shingles fall on it: sets differ in at least as many shingles as their bitmaps do in bits, so that most pairs that are not
# similar never leave the join.

STAGE_WORDS = 5
#: The search of fingerprints is complete for so many bits; pairs that meet in it are candidates up to so many.
STAGE_RADIUS, STAGE_DISTANCE = 4, 10
STAGE_PARTS = (2, 3, 4, 5)
#: The similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: The cells that shingles are counted in, and of one block of them.
CELL_BITS, BLOCK_CELL_BITS = 22, 16
#: Cells are ranked by the logarithm of their count, in so many steps a doubling.
RANKS_A_DOUBLING = 8
PARITY_WORDS = 8
#: Texts are hashed about so many bytes at a time, and sent on about so many hashes at a time.
SLICE_BYTES, BATCH_HASHES = 2_000_000, 200_000


def stage_shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text, the distinct 64-bit hashes of its shingles of STAGE_WORDS words, ascending; that of the whole sequence
    where it has fewer words. A-Z count as a-z, words lie between ASCII white space; each distinct word is hashed once."""
    import pyarrow.compute as pc
    import xxhash

    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(at, stop - at))))
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        w = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[np.asarray(coded.indices)]
        blank = known.index(b"") if b"" in known else -1

        def mixed(k: int, w: np.ndarray) -> np.ndarray:
            h = np.full(max(len(w) - k + 1, 0), k, np.uint64)
            for i in range(k):
                h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return h * np.uint64(0xBF58476D1CE4E5B9)

        whole, codes = mixed(STAGE_WORDS, w), np.asarray(coded.indices)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b == a or (b == a + 1 and codes[a] == blank):
                yield np.zeros(0, np.uint64)
            elif b - a < STAGE_WORDS:
                yield mixed(b - a, w[a:b])
            else:
                yield np.unique(whole[a : b - STAGE_WORDS + 1])
        at = stop


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def similar(shared: Column, n: Column, n2: Column) -> Column:
    """Whether sets of n and n2 that share so many have the similarity; two empty sets have it."""
    a, b = SIMILAR
    return (a + b) * shared >= a * (n + n2)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_ranks(docs: DataFrame) -> np.ndarray:
    """By cell, a rank that grows with the number of all documents that have a shingle there. Every task sums up its own
    documents in one array, and sends it in blocks; what reaches the driver are a byte a cell."""
    blocks = 1 << (CELL_BITS - BLOCK_CELL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((blocks, 1 << BLOCK_CELL_BITS), "<u4")
        flat = found.reshape(-1)
        for batch in batches:
            for h in stage_shingles(batch.column(0)):
                flat[_cells(h)] += 1  # a cell that several shingles of a text fall on counts once
        used = [b for b in range(blocks) if found[b].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([found[b].tobytes() for b in used], pa.binary())], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, "<u4")
                total[b] = total[b] + own if b in total else own.astype(np.int64)
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["block", "sums"])

    parts = docs.select("text").mapInArrow(giving_back(count), "block int, counts binary")
    sums = written(parts.repartition(min(blocks, 64), "block").mapInArrow(giving_back(added), "block int, sums binary"), "cells")
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = [np.minimum(np.log2(np.maximum(np.frombuffer(x, "<i8"), 1)) * RANKS_A_DOUBLING, 255).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rank, pa.binary())], ["block", "ranks"])

    out = np.zeros((blocks, 1 << BLOCK_CELL_BITS), np.uint8)
    for r in sums.select("block", "sums").mapInArrow(ranked, "block int, ranks binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["ranks"], np.uint8)
    dropped(sums)
    return out.reshape(-1)


def parity(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """fid, n (distinct shingles), mark (their SimHash), prefix, bits (the bitmap); a text without words has n = 0, and the
    mark and the prefix 0."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a byte a cell, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value

        def made(rows: list[tuple]) -> pa.RecordBatch:
            fid, sizes, marks, heads, bits = zip(*rows, strict=True)
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).view(np.int64)))
            words = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bits)), PARITY_WORDS).cast(pa.list_(pa.int64()))
            mark = pa.array(np.frombuffer(b"".join(marks), ">i8").astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(fid, pa.int64()), pa.array(sizes, pa.int32()), mark, prefix, words], ["fid", "n", "mark", "prefix", "bits"])

        for batch in batches:
            rows, held = [], 0
            for fid, h in zip(batch.column(0).to_pylist(), stage_shingles(batch.column(1)), strict=True):
                head = h[np.argsort(rank[_cells(h)], kind="stable")[: prefix_length(len(h))]] if len(h) else np.zeros(1, np.uint64)
                rows.append((fid, len(h), simhash_of(h), head, parity(h)))
                held += len(head)
                if held >= BATCH_HASHES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return docs.select("fid", "text").mapInArrow(giving_back(run), "fid long, n int, mark long, prefix array<long>, bits array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b of the candidates (a, b) whose shingle sets have the similarity; only the texts of candidates are read again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(fids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(fids, pa.int64()), sets], ["fid", "set"])

        for batch in batches:
            fids, found, held = [], [], 0
            for fid, h in zip(batch.column(0).to_pylist(), stage_shingles(batch.column(1)), strict=True):
                fids.append(fid)
                found.append(h)
                held += len(h)
                if held >= BATCH_HASHES:
                    yield made(fids, found)
                    fids, found, held = [], [], 0
            if fids:
                yield made(fids, found)

    pairs = written(pairs, "candidates")
    total = pairs.count()
    wanted = pairs.select(F.col("a").alias("fid")).union(pairs.select(F.col("b").alias("fid"))).distinct()
    own = docs.select("fid", "text").join(wanted, "fid", "left_semi").groupBy("fid").agg(F.first("text").alias("text")).mapInArrow(giving_back(sets), "fid long, set array<long>")
    own = written(own, "sets")
    out = pairs
    for end in ("a", "b"):
        groups = own.select(F.col("fid").alias(end), F.col("set").alias(f"{end}_set")).join(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("met")), end)
        out = join_groups(out, groups, [end], "met", total).drop("met")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    out = written(out.where(similar(shared, F.size("a_set"), F.size("b_set"))).select("a", "b"), "verified")
    dropped(pairs, own)
    return out


def fingerprint_candidates(marks: DataFrame) -> DataFrame:
    """a, b of the texts (fid, mark; one row a text) whose SimHashes the pigeonhole search links. Of equal fingerprints one
    text stands for all, and the others are candidates with it."""
    fps = written(marks.groupBy("mark").agg(F.min("fid").alias("stands"), F.count(F.lit(1)).alias("docs")), "marks")
    links = near_links(fps.select(F.col("mark").alias("fid"), F.array("mark").alias("fp"), "docs"), 1, STAGE_DISTANCE, STAGE_RADIUS, STAGE_PARTS)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(fps.select(F.col("mark").alias(end), F.col("stands").alias(f"{end}_text")), end)
    equal = join_groups(marks, fps.where("docs > 1"), ["mark"], "docs", marks.count()).where("fid <> stands")
    pairs = ends.select("a_text", "b_text").union(equal.select("fid", "stands")).toDF("a", "b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "linked-texts")
    dropped(fps, links)
    return pairs


def similar_components(docs: DataFrame) -> DataFrame:
    """node, root of the texts (fid, text; rows may repeat) that have a link: shingle sets with the similarity.

    First the links that the search of fingerprints finds, checked on the whole sets. Then prefixes: a similar pair passes `may` at the first value that its prefixes share: no more than what follows there, in the shorter
    rest, can be shared. Each member of a value meets one leader (by a hash of both, so that a document meets others
    at other values), which is linear and unites all but few; then pairs of sets that these haven't united are met.
    """
    heads = written(prefixes(docs, cell_ranks(docs)).groupBy("fid").agg(*(F.first(c).alias(c) for c in ("n", "mark", "prefix", "bits"))), "prefixes")
    linked = fingerprint_candidates(heads.select("fid", "mark"))
    give_back_on_driver(docs.sparkSession)
    near = verified(linked, docs)
    dropped(linked)
    give_back_on_driver(docs.sparkSession)
    sets = connected_components(near)
    members = heads.select("fid", "n", F.posexplode("prefix").alias("at", "value"))
    a, b = SIMILAR  # the smaller set of a pair has the first value that they share among its first (b - a) / (a + b)
    front = (a + b) * F.col("at") <= (b - a) * F.col("n")
    shared = members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.max(front).alias("front")).where("size > 1 AND front").select("value")
    members = written(members.join(shared, "value"), "members")
    bits = [f"b{i}" for i in range(PARITY_WORDS)]
    maps = heads.select("fid", *(F.col("bits")[i].alias(c) for i, c in enumerate(bits)))
    own = ["fid", "n", "at"]
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("b02")))
    for c in bits[1:]:
        differ = differ + F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2")))
    # shared >= a / (a + b) * (n + n2), and shared <= (n + n2 - differ) / 2
    few = (a + b) * differ <= (b - a) * (F.col("n") + F.col("n2"))
    may = similar(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")), F.col("n"), F.col("n2"))

    lead = members.groupBy("value").agg(F.max_by(F.struct(*own), F.xxhash64("fid", "value")).alias("lead")).select("value", *(F.col(f"lead.{c}").alias(f"{c}2") for c in own))
    first = members.join(lead, "value").where((F.col("fid") != F.col("fid2")) & may)
    first = first.select(F.least("fid", "fid2").alias("fid"), F.greatest("fid", "fid2").alias("fid2"), (F.col("n") + F.col("n2")).alias("n")).distinct()
    first = first.join(maps, "fid").join(maps.select(F.col("fid").alias("fid2"), *(F.col(c).alias(f"{c}2") for c in bits)), "fid2").withColumn("n2", F.lit(0))
    first = first.where(few).select(F.col("fid").alias("a"), F.col("fid2").alias("b"))
    for end in ("a", "b"):
        first = first.join(sets.select(F.col("node").alias(end), F.col("root").alias(f"{end}_set")), end, "left")
    apart = F.coalesce("a_set", "a") != F.coalesce("b_set", "b")
    star = near.union(verified(first.where(apart).select("a", "b"), docs))
    united = connected_components(star)
    give_back_on_driver(docs.sparkSession)
    placed = members.join(united.withColumnRenamed("node", "fid"), "fid", "left")
    members_in = written(placed.select("value", *own, F.coalesce("root", "fid").alias("set")), "members-in")
    dropped(members)
    largest = members_in.groupBy("value", "set").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max_by("set", F.struct("n", "set")).alias("largest"), F.count(F.lit(1)).alias("sets"))
    valued = written(members_in.join(largest.where("sets > 1").drop("sets"), "value").join(maps, "fid"), "valued")
    dropped(members_in, heads)
    met = valued.select("value", *(F.col(c).alias(f"{c}2") for c in (*own, *bits)), F.col("set").alias("set2"))
    once = (F.col("set2") == F.col("largest")) | (F.col("fid") < F.col("fid2"))  # each pair once a value
    pairs = valued.where(F.col("set") != F.col("largest")).join(met, "value").where((F.col("set") != F.col("set2")) & once & may & few)
    give_back_on_driver(docs.sparkSession)
    found = verified(pairs.select(F.least("fid", "fid2").alias("a"), F.greatest("fid", "fid2").alias("b")).distinct(), docs)
    dropped(valued)
    return connected_components(star.union(found))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of docs, all columns, without those that are near another that stays: of a component one row stays,
    of its smallest doc_id (a null one comes last), then of the smallest text hash. Rows that repeat both doc_id and text
    are one document. Equal texts are told by a 64-bit hash."""
    fid = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fid.alias("fid"), F.col(text).alias("text"))
    rows = written(sent.groupBy("doc_id", "fid").agg(F.count(F.lit(1)).alias("rows")), "rows")
    roots = similar_components(sent.select("fid", "text")).withColumnRenamed("node", "fid")
    rooted = rows.join(roots, "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fid", "rows")).alias("x")).select(F.col("x.doc_id").alias("stay_id"), F.col("x.fid").alias("stay_fid"), F.col("x.rows").alias("stay_rows"))
    stays = written(stays, "stays")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (fid == F.col("stay_fid"))
    once = docs.join(stays.where("stay_rows = 1"), here, "left_semi")
    if stays.where("stay_rows > 1").limit(1).count():
        once = once.unionByName(docs.join(stays.where("stay_rows > 1"), here, "left_semi").dropDuplicates(["doc_id", text]))
    return once
