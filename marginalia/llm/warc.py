"""WARC records and a Merkle audit of their replicas.

Records lie in WARC files at byte offsets. An audit hashes every record, then the ordered
records of each byte range of a file (`RANGE_BYTES`), then `FANOUT` neighbouring nodes at a
time up to one root per file. Two replicas are compared at the roots first; only children of
nodes that differ are compared further, down to ranges and there record by record. So a sound
file costs one comparison, and a damaged one the branches above its damage. Ranges are fixed
by offset: a lost record does not shift its neighbours into other ranges.

Cases: null html is an empty payload, a null url an empty target; rows that repeat a page_id
are records of their own, in the order of their digests; a record missing in one replica is
`missing` or `extra`, a null digest differs from every other; empty replicas give no findings
against each other; other columns are ignored.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.llm.shared import held

RANGE_BYTES = 1 << 16
FANOUT = 16
PAGES_PER_FILE = 1000
RECORDS = "path string, offset long, length long, type string, target string, payload binary"


def record(url: Column, html: Column, ident: Column) -> Column:
    """A whole WARC resource record as text; its bytes are the text in UTF-8."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(ident.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, order: list[str]) -> DataFrame:
    """Records (file, length, …) with their byte offset in the file, in the given order.

    Sizes are summed within range partitions and then over the partitions before, so a file
    that holds a third of all records is still many tasks. `order` decides up to equal rows.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(parts, "file", *order).withColumn("_part", F.spark_partition_id())
    fixed = held(ranged)
    sums = fixed.groupBy("file", "_part").agg(F.sum("length").alias("_size"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("file").alias("_file"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = fixed.withColumn("_inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    joined = summed.join(sums, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("offset", F.col("_before") + F.col("_inside")).drop("_file", "_p", "_part", "_before", "_inside")


def _combined(parts: Column) -> Column:
    """Digest of ordered children: (position, digest) structs."""
    lines = F.transform(F.sort_array(parts), lambda p: F.concat_ws(":", p["at"].cast("string"), F.coalesce(p["digest"], F.lit(""))))
    return F.sha2(F.concat_ws("\n", lines), 256)


def ranges(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Level 0 of the trees: file, node, digest of each byte range's ordered records.

    A range holds at most its bytes over the smallest record's, however large the file is.
    """
    own = F.struct(F.col("offset").alias("at"), F.concat_ws(":", F.col("length").cast("string"), "digest").alias("digest"))
    node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
    return records.groupBy("file", node).agg(_combined(F.collect_list(own)).alias("digest"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    child = F.struct(F.col("node").alias("at"), "digest")
    up = F.floor(F.col("node") / fanout).cast("long")
    return level.groupBy("file", up.alias("node")).agg(_combined(F.collect_list(child)).alias("digest"))


def tree(records: DataFrame, depth: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels from the ranges to the roots."""
    levels = [held(ranges(records, range_bytes))]
    for _ in range(depth):
        levels.append(held(parents(levels[-1], fanout)))
    return levels


def _different(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, node) whose digests differ or that only one side has."""
    a = left.select("file", "node", F.col("digest").alias("_a"))
    b = right.select("file", "node", F.col("digest").alias("_b"))
    return a.join(b, ["file", "node"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "node")


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas (file, offset, length, digest).

    Returns file, offset, length, status (altered, missing: only in the first, extra: only in
    the second) and both digests. Offsets of a replica are unique in a file.
    """
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in (first, second)]
    depth, top = 0, max(ends) // range_bytes
    while top:
        depth, top = depth + 1, top // fanout
    trees = [tree(r, depth, range_bytes, fanout) for r in (first, second)]
    suspects = _different(trees[0][depth], trees[1][depth])
    for level in range(depth - 1, -1, -1):
        wanted = held(suspects).select("file", F.col("node").alias("_up"))
        near = [
            t[level].withColumn("_up", F.floor(F.col("node") / fanout).cast("long")).join(wanted, ["file", "_up"], "left_semi")
            for t in trees
        ]
        suspects = _different(*near)
    bad = held(suspects)
    kept = [
        r.select("file", "offset", "length", "digest", F.floor(F.col("offset") / range_bytes).cast("long").alias("node"))
        .join(bad, ["file", "node"], "left_semi").select("file", "offset", F.col("length").alias(f"_n{k}"), F.col("digest").alias(f"_d{k}"))
        for k, r in enumerate((first, second))
    ]
    both = kept[0].join(kept[1], ["file", "offset"], "full")
    same = F.col("_d0").eqNullSafe(F.col("_d1")) & F.col("_n0").eqNullSafe(F.col("_n1"))
    status = F.when(F.col("_n1").isNull(), "missing").when(F.col("_n0").isNull(), "extra").otherwise("altered")
    return both.filter(~same | F.col("_n0").isNull() | F.col("_n1").isNull()).select(
        "file", "offset", F.coalesce("_n0", "_n1").alias("length"), status.alias("status"),
        F.col("_d0").alias("first_digest"), F.col("_d1").alias("second_digest"),
    )


def page_records(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Pages as laid-out records: file, offset, length, digest, page_id.

    A file takes the pages of `per_file` consecutive ids; pages without id share file -1.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    text = record(F.col("url"), F.col("html"), F.col("page_id"))
    file = F.coalesce(F.floor(F.col("page_id") / per_file).cast("long"), F.lit(-1).cast("long"))
    narrow = pages.select(file.alias("file"), "page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    return laid_out(narrow, ["page_id", "digest"])


_LENGTH = re.compile(rb"^content-length:\s*(\d+)", re.I | re.M)
_TARGET = re.compile(rb"^warc-target-uri:\s*(.*?)\s*$", re.I | re.M)
_TYPE = re.compile(rb"^warc-type:\s*(\S+)", re.I | re.M)


def parse_warc(content: bytes) -> list[tuple[int, int, str, str, bytes]]:
    """(offset, length, type, target, payload) of every record of an uncompressed WARC file.

    A record cut short at the end of the file keeps what is there.
    """
    found, at = [], 0
    while (begin := content.find(b"WARC/", at)) >= 0:
        split = content.find(b"\r\n\r\n", begin)
        if split < 0:
            break
        head = content[begin:split]
        size = _LENGTH.search(head)
        end = split + 4 + (int(size[1]) if size else 0)
        at = min(end + 4, len(content))
        kind, target = _TYPE.search(head), _TARGET.search(head)
        text = [m[1].decode("utf-8", "replace") if m else "" for m in (kind, target)]
        found.append((begin, at - begin, *text, content[split + 4 : end]))
    return found


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files (gzip or plain) under a path; files are read by Spark, one per row.

    Offsets of compressed files are those in the unpacked file.
    """

    def parsed(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                plain = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(name, *r) for r in parse_warc(plain)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "length", "type", "target", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parsed, RECORDS)
