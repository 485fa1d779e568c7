"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader deals the archives' bytes out in ranges. A task looks for the gzip magic in its range, takes a candidate for
a member if the bytes from there inflate to a WARC header, and reads the records that start inside its range, to their
ends. Compressed data may hold the magic by chance; then it doesn't inflate to a header. Files are written under a name
of the attempt and then moved, so that a lost executor leaves nothing half written under a final name.

Defined cases: a null html counts as empty; of equal payloads the largest page_id is the response and all others revisit
it, rows without a page_id included (if none has one, one of them is the response); rows that repeat page_id and html are
records of their own; an empty table gives an empty result; other columns are ignored. The reader takes records of any
WARC version; of a foreign record, headers that it lacks are null, and other types than response and revisit are returned
with their whole block as payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, scratch_path, written

SPLIT_BYTES = 16 << 20
#: What a record of any version begins with.
HEAD = b"WARC/"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """The file system of a path and the path in it; the path must name its scheme, as without one the executors' own
    disks would be meant here, and the default file system by Spark."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        raise ValueError(f"{path} needs a scheme, such as file:// or hdfs://")
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    return fs.FileSystem.from_uri(path)


def response_id(page_id: int | None, digest: str) -> bytes:
    """The record id of the response among the records of a payload."""
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{digest}")).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, record_id: bytes | None = None) -> bytes:
    """One gzip member. record_id: by default that of the payload's response."""
    block, digest = HTTP if revisit else HTTP + payload, payload_digest(payload)
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + (record_id or response_id(page_id, digest)),
        b"WARC-Date: 2024-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (url or "about:blank").replace("\r", "").replace("\n", "").encode("utf-8", "replace"),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + response_id(refers_to, digest), b"X-Payload-Length: %d" % len(payload)]
        if refers_to is not None:
            lines.append(b"X-Refers-To-Page-ID: %d" % refers_to)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to, single (whether it is the only response of its payload) of every row."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    # ids and digests alone are grouped; the texts are joined with what was decided for few of them
    slim = written(rows.select("page_id", "digest", "n").groupBy("page_id", "digest", "n").agg(F.count(F.lit(1)).alias("copies")), "payload-digests")
    # of rows that repeat id and payload of the response one is it: twins tells whether there are any
    groups = slim.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.sum("copies").alias("size"), F.max_by("copies", "page_id").alias("top_copies")).where("size > 1")
    groups = written(groups.select("digest", "top", "size", (F.col("top").isNull() | (F.col("top_copies") > 1)).alias("twins")), "payload-groups")
    # the pages of a payload that very many have are not dealt by it
    rows = join_groups(rows, groups, ["digest"], "size", slim.agg(F.sum("copies")).first()[0] or 0, "left").withColumn("twins", F.coalesce("twins", F.lit(False)) & F.col("page_id").eqNullSafe(F.col("top")))
    rows = rows.withColumn("nth", F.lit(1))
    if not groups.where("twins").isEmpty():  # repeated rows need a number among themselves, and the join a second time
        # one of them is the response, told by its url (of several the least) and, where that repeats too, by a number
        least = written(rows.where("twins").groupBy("digest", "page_id").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("least")), "twins")
        least = least.select(F.col("digest").alias("d2"), F.col("page_id").alias("p2"), F.col("least.url").alias("u2"))
        hit = (F.col("digest") == F.col("d2")) & F.col("page_id").eqNullSafe(F.col("p2")) & F.col("url").eqNullSafe(F.col("u2"))
        twins = rows.where("twins").join(least, hit, "left").withColumn("hit", F.col("d2").isNotNull()).drop("d2", "p2", "u2")
        own = Window.partitionBy("digest", "page_id").orderBy("url")
        first = twins.where("hit").withColumn("nth", F.row_number().over(own))
        rows = rows.where("not twins").unionByName(first.drop("hit")).unionByName(twins.where("NOT hit").drop("hit").withColumn("nth", F.lit(2)))
    is_response = F.col("size").isNull() | (F.col("page_id").eqNullSafe(F.col("top")) & (F.col("nth") == 1))
    return rows.select("page_id", "url", "html", (~is_response).alias("revisit"), F.when(~is_response, F.col("top")).alias("refers_to"), (F.col("n") >= min_bytes).alias("single"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> list[tuple[str, int]]:
    """Write a record per row of pages under path; the archives as (file, bytes), one a task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        size, out, at = 0, None, 0
        for batch in batches:
            for page_id, url, html, revisit, refers_to, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.attempt", compression=None)
                at += 1
                own = None if single and not revisit else b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_OID, f"{name}:{at}")).encode()
                size += out.write(record(page_id, url, html.encode("utf-8", "replace"), refers_to, revisit, own))
        if out is not None:
            out.close()
            fs.move(f"{root}/{name}.attempt", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([size])], ["file", "bytes"])

    rows = decided(pages, min_bytes).mapInArrow(write, "file string, bytes long")
    # a table of what the attempts that count wrote: files of other attempts are never read
    return [(r["file"], r["bytes"]) for r in written(rows, "warc-files").collect()]


def split_ranges(files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> list[tuple[str, int, int]]:
    return [(f, a, min(a + split, n)) for f, n in files for a in range(0, n, split)]


def members(handle, start: int, stop: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The records whose members start in [start, stop) of the file, inflated."""
    size = handle.size()
    at = start
    while at < stop:
        handle.seek(at)
        window = handle.read(min(step, stop - at) + 2)
        hit = window.find(b"\x1f\x8b\x08")
        if hit < 0:
            at += max(len(window) - 2, 1)
            continue
        at += hit
        if at >= stop:
            return
        got = _inflated(handle, at, size)
        if got is None:
            at += 1
            continue
        body, end = got
        yield body
        at = end


def _inflated(handle, at: int, size: int, step: int = 1 << 18) -> tuple[bytes, int] | None:
    inflate, out, pos = zlib.decompressobj(31), [], at
    checked = False
    while not inflate.eof:
        if pos >= size:
            return None
        handle.seek(pos)
        data = handle.read(1 << 13 if not checked else step)
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            return None
        pos += len(data)
        if not checked:  # a member is one if it begins like a record
            first = b"".join(out)
            if len(first) >= len(HEAD) or inflate.eof:
                if not first.startswith(HEAD):
                    return None
                checked = True
    return b"".join(out), pos - len(inflate.unused_data)


def parsed(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the payload, the HTTP headers taken off."""
    head, _, rest = body.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().decode("ascii", "replace").lower()] = v.strip().decode("utf-8", "replace")
    block = rest[: int(headers.get("content-length", 0))]
    if not headers.get("content-type", "application/http").startswith("application/http"):
        return headers, block
    return headers, block.partition(b"\r\n\r\n")[2]


def read_archives(spark: SparkSession, path: str, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, target_uri, payload of every record."""
    ranges = split_ranges(files, split)
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string, payload binary"
    if not ranges:
        return spark.createDataFrame([], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        number = lambda x: None if x is None else int(x)

        def batch_of(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "target_uri", "payload"])

        for batch in batches:
            for file, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{file}") as handle:
                    for body in members(handle, a, b):
                        h, payload = parsed(body)
                        kind = h.get("warc-type")
                        if kind == "revisit":
                            rows.append((number(h.get("x-page-id")), kind, number(h.get("x-refers-to-page-id")), number(h.get("x-payload-length")), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, h.get("warc-target-uri"), None))
                        else:
                            rows.append((number(h.get("x-page-id")), kind, None, len(payload), payload_digest(payload), h.get("warc-target-uri"), payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    dealt = spark.createDataFrame(ranges, "file string, start long, stop long").repartition(len(ranges))
    return dealt.mapInArrow(scan, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from archives."""
    path = scratch_path(pages.sparkSession, "warc")
    files = write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
