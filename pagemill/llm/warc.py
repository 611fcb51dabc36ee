"""WARC records and their Merkle fixity audit.

A record's bytes are hashed; the records of a file are hashed by ordered ranges of offsets into leaves, and FANOUT children
into each node above, up to one root a file. An audit compares the roots of two replicas, then only children of nodes that
differ, level by level, and in the end the records of differing leaves: a lost, added or altered record costs one path.

A leaf holds the records that start in a range of RANGE bytes, a node FANOUT children, so every group is bounded; what
moves are digests of 32 bytes, never record bodies.

Defined results: null bodies and addresses count as empty; records of a null file are a file of their own, and so are
compared; null and repeated keys are records like any other, each at its own offset; repeated records at one place must be
repeated in the replica too; a very long record is hashed whole; an empty table has no roots, and all of the other replica is
missing or extra; only the columns named are read, whatever others there are; read_records() gives a truncated last record as
it is, with `complete` false.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import cut

RANGE, FANOUT = 1 << 16, 16


def record(url: Column, body: Column, record_id: Column) -> Column:
    """The bytes of one WARC/1.1 resource record."""
    body = F.coalesce(body.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:pagemill:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def index(records: DataFrame, file_col: str, order_col: str, record_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, key, offset, length, digest, and the columns to carry): where each record stands if a file's records follow in
    the order given, equal keys by digest.

    Records are hashed once and sorted by ranges of the order; a file's sums of lengths go in two levels, over its ranges and
    within each, so that a file of very many records is many tasks.
    """
    narrow = records.select(
        F.col(file_col).alias("file"), F.col(order_col).alias("key"),
        F.octet_length(record_col).cast("long").alias("length"), F.sha2(F.col(record_col), 256).alias("digest"), *[F.col(c) for c in carry],
    )
    ranged = cut(cut(narrow).repartitionByRange("file", "key", "digest").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("file", "_range").agg(F.sum("length").alias("_sum"))
    first = F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sums.select(F.col("file").alias("_file"), F.col("_range").alias("_at"), first.alias("_start")))
    before = Window.partitionBy("file", "_range").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("length").over(before), F.lit(0)))
    placed = placed.join(starts, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_range") == F.col("_at")))
    return placed.select("file", "key", (F.col("_start") + F.col("_before")).alias("offset"), "length", "digest", *carry)


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels of (file, node, hash), leaves first, up to one node a file."""
    entry = F.concat_ws(":", F.col("offset"), F.col("length"), F.col("digest"))
    leaves = found.select("file", F.floor(F.col("offset") / RANGE).alias("node"), "offset", entry.alias("entry"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "entry"))), lambda x: x["entry"]), "\n")
    levels = [cut(leaves.groupBy("file", "node").agg(F.sha2(joined, 256).alias("hash")))]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top:
        children = levels[-1].select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.struct("node", "hash").alias("child"))
        # Children are named with their places: an absent one isn't the same as a moved one.
        text = F.array_join(F.transform(F.sort_array(F.collect_list("child")), lambda x: F.concat_ws(":", x["node"], x["hash"])), "\n")
        levels.append(cut(children.groupBy("file", "node").agg(F.sha2(text, 256).alias("hash"))))
        top //= FANOUT
    return levels


def _differing(left: DataFrame, right: DataFrame, within: DataFrame | None) -> DataFrame:
    """(file, node) of one level whose hashes differ, below the nodes `within` of the level above."""
    if within is not None:
        above = within.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
        left, right = (x.join(above, F.col("file").eqNullSafe(F.col("_f")) & (F.floor(F.col("node") / FANOUT) == F.col("_n")), "left_semi") for x in (left, right))
    tagged = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2)))
    both = tagged.groupBy("file", "node").agg(F.max(F.when(F.col("side") == 1, F.col("hash"))).alias("a"), F.max(F.when(F.col("side") == 2, F.col("hash"))).alias("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, key, status) of the records that differ: corrupt, missing (from the replica) or extra (in it)."""
    one, two = tree(primary), tree(replica)
    while len(one) < len(two):
        one.append(_raised(one[-1]))
    while len(two) < len(one):
        two.append(_raised(two[-1]))
    differing = None
    for left, right in zip(reversed(one), reversed(two), strict=True):
        differing = cut(_differing(left, right, differing))
    leaf = differing.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    inside = F.col("file").eqNullSafe(F.col("_f")) & (F.floor(F.col("offset") / RANGE) == F.col("_n"))
    sides = [x.join(leaf, inside, "left_semi").withColumn("side", F.lit(k)) for k, x in enumerate((primary, replica))]
    mine, theirs = (F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("length", "digest")))) for k in (0, 1))
    # A group is the records that stand at one place.
    at = sides[0].unionByName(sides[1]).groupBy("file", "offset").agg(F.min("key").alias("key"), mine.alias("a"), theirs.alias("b"))
    status = F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "extra").otherwise("corrupt")
    return at.where(F.col("a") != F.col("b")).select("file", "offset", "key", status.alias("status"))


def _raised(level: DataFrame) -> DataFrame:
    """The level above a single root a file, for a replica whose tree is lower."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"], x["hash"])), "\n")
    return level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(text, 256).alias("hash"))


def parse(data: bytes) -> Iterator[tuple[int, int, str, bytes, bool]]:
    """(offset, length, address, body, complete) of the records of an uncompressed WARC file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            yield at, len(data) - at, "", b"", False
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:head].split(b"\r\n")[1:])}
        size = int(m[0]) if (m := re.match(rb"\d+", fields.get(b"content-length", b""))) else 0
        end = head + 4 + size + 4
        yield at, min(end, len(data)) - at, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[head + 4 : head + 4 + size], end <= len(data)
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, body, complete) of WARC files, plain or gzip. A file is read in one task, whole: this is
    for files of some 100 MB at most (2 GB is the bound of Spark's binary files)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files["path"], files["content"], strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                rows = [(name, *x) for x in parse(data)]
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "body", "complete"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset long, length long, url string, body binary, complete boolean")
