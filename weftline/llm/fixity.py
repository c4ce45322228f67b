"""Merkle fixity audit of replicas of WARC files.

A record's hash covers its bytes. The leaf of a tree is a range of offsets of a file; its hash covers offset, length and hash
of the records that begin in it, in order. Every node above covers ``FAN`` neighbouring ranges, and the root the file. Two
replicas are compared from the roots down: only children of nodes that differ are compared, so of sound files
nothing but the roots is looked at, and a damaged record is found on one path. At the leaves, records are compared.

Each level is a table of grouped hashes, written once; descending is a join of the two tables of a level with the nodes
that differ. Records are never gathered beyond the range of one leaf.

Defined cases: a null payload counts as empty, and null offsets, lengths or files are left out; of records that share file and offset the hash covers
all, and they match if the sorted lists of their lengths and hashes are equal, so a record whose stated length alone differs is changed; an empty replica lacks every record; two empty ones give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps

LEAF = 1 << 18  # bytes of a file that a leaf covers
FAN = 16

#: The date that records have whose page has none.
DATE = "2024-01-01T00:00:00Z"

_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?Content-Length:[ \t]*([0-9]+)[ \t]*\r\n(?:[^\r\n]+\r\n)*\r\n", re.IGNORECASE)
_NEXT = re.compile(rb"WARC/1\.[01]\r\n")


def warc_record(uri: Column, content: Column, number: Column, date: str = DATE) -> Column:
    """The text of a WARC/1.0 resource record, with the two line ends after it. ``uri`` and ``content``: text."""
    body = F.coalesce(content, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:weft:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, *, key: str = "page_id", uri: str = "url", content: str = "html", per_file: int = 1000, date: str = DATE) -> DataFrame:
    """(file, offset, length, key, payload): ``pages`` as records of WARC files with the pages of ``per_file`` consecutive keys each.

    Pages without a key are in no file. Records of a file follow their keys, those of one key a digest. Offsets are sums over (key, digest, length) alone; payloads are dealt by
    these and never sorted by file. Pages that are alike in all columns lie side by side.
    """
    record = warc_record(F.col(uri), F.col(content), F.col(key), date)
    rows = pages.where(F.col(key).isNotNull()).select(F.floor(F.col(key) / per_file).cast("long").alias("file"), F.col(key).alias("key"), record.cast("binary").alias("payload"))
    rows = rows.select("file", "key", F.xxhash64("payload").alias("tie"), F.octet_length("payload").cast("long").alias("length"), "payload")
    same = ["key", "tie", "length"]
    alike = rows.groupBy("file", *same).agg(F.count("*").alias("n"))
    upto = F.sum(F.col("n") * F.col("length")).over(Window.partitionBy("file").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1))
    begins = alike.select(*same, F.coalesce(upto, F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("begin")) - 1
    return rows.join(begins, same).withColumn("offset", F.col("begin") + nth * F.col("length")).select("file", "offset", "length", "key", "payload")


def write_warc(records: DataFrame, path: str) -> None:
    """Write (file, offset, payload) as WARC files, a folder ``file=...`` for each, records in the order of their offsets. Payloads are UTF-8.

    The two line ends of a record are what Spark's text writer puts after each row.
    """
    end = F.octet_length("payload") - 4
    rows = records.select("file", "offset", F.expr("substring(payload, 1, octet_length(payload) - 4)").cast("string").alias("value")).where(end >= 0)
    rows.repartition("file").sortWithinPartitions("file", "offset").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n\r\n").text(path)


def _plain_records(raw: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, payload). What cannot be read as a record goes up to the next one that begins with a version line."""
    at = 0
    while at < len(raw):
        found = _HEAD.match(raw, at)
        end = found.end() + int(found[1]) + 4 if found else at
        if not found or end > len(raw) or raw[end - 4 : end] != b"\r\n\r\n":
            following = _NEXT.search(raw, at + 1)
            end = following.start() if following else len(raw)
        yield at, end - at, bytes(raw[at:end])
        at = end


def _packed_records(raw: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """The same for a file of gzip members, one for each record: offset and length are those of the member, the payload is what it holds. What is no whole member is one record, as it is."""
    at = 0
    while at < len(raw):
        member = zlib.decompressobj(wbits=31)
        try:
            payload = member.decompress(raw[at:])
            end = len(raw) - len(member.unused_data) if member.eof else -1
        except zlib.error:
            end = -1
        if end < 0:
            payload, end = bytes(raw[at:]), len(raw)
        yield at, end - at, payload
        at = end


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, offset, length, payload) of the records in whole files."""
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = memoryview(raw.as_buffer())
            found = _packed_records(raw) if bytes(raw[:2]) == b"\x1f\x8b" else _plain_records(raw)
            while some := list(islice(found, 1000)):
                offset, length, payload = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(payload, pa.binary())], ["file", "offset", "length", "payload"])


def read_warc(files: DataFrame) -> DataFrame:
    """(file, offset, length, payload) of WARC files, plain or of a gzip member for each record, from (path, content) as Spark's ``binaryFile`` reads them. A file is read by one task."""
    return files.select("path", "content").mapInArrow(_members, "file string, offset long, length long, payload binary")


def record_hashes(records: DataFrame) -> DataFrame:
    """(file, offset, length, hash) of the records (file, offset, length, payload)."""
    found = records.where("file is not null and offset is not null and length is not null")
    return found.select("file", "offset", "length", F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("hash"))


def merkle_levels(steps: Steps, hashed: DataFrame, heights: int) -> list[DataFrame]:
    """Tables (file, node, hash), leaves first; ``heights``: how many levels are over the leaves. The last one has one node for each file."""
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), "hash")
    leaf = hashed.groupBy("file", F.floor(F.col("offset") / LEAF).cast("long").alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256).alias("hash"))
    levels = [steps.cut(leaf, "merkle_leaves")]
    for _ in range(heights):
        part = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(part)), ","), 256).alias("hash"))
        levels.append(steps.cut(up.withColumnRenamed("up", "node"), "merkle_level"))
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, length, state) of the records that are ``changed``, ``missing`` or ``extra`` in ``replica``.

    Both are tables (file, offset, length, payload). length: that of the original, or of the replica for extra records.
    """
    steps = Steps(original.sparkSession)
    left, right = steps.cut(record_hashes(original), "hashes"), steps.cut(record_hashes(replica), "hashes")
    last = left.unionByName(right).agg(F.max("offset")).first()[0]
    heights, reach = 0, (last or 0) // LEAF
    while reach:
        heights, reach = heights + 1, reach // FAN
    ours, theirs = merkle_levels(steps, left, heights), merkle_levels(steps, right, heights)
    bad: DataFrame | None = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if bad is not None:
            up = F.floor(F.col("node") / FAN).cast("long").alias("up")
            a, b = (t.select("*", up).join(bad, ["file", "up"], "left_semi").drop("up") for t in (a, b))
        met = a.select("file", "node", F.col("hash").alias("h1")).join(b.select("file", "node", F.col("hash").alias("h2")), ["file", "node"], "full_outer")
        bad = steps.cut(met.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", F.col("node").alias("up")), "differing")
    steps.finish(left, right, bad)
    leaf = F.floor(F.col("offset") / LEAF).cast("long").alias("up")

    def records(t: DataFrame, side: str) -> DataFrame:
        own = t.select("*", leaf).join(bad, ["file", "up"], "left_semi")
        return own.groupBy("file", "offset").agg(F.max("length").alias(f"{side}_length"), F.sort_array(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "hash"))).alias(side))

    both = records(left, "ours").join(records(right, "theirs"), ["file", "offset"], "full_outer")
    state = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "offset", F.coalesce("ours_length", "theirs_length").alias("length"), state.alias("state"))
