r"""WARC records and a Merkle fixity audit of replicas.

Records are rendered as WARC/1.0 response records and ordered within files; each has its offset, length and SHA-256.
Leaves are hashed into ordered ranges of `fanout` records, ranges into ranges, up to one root a file, level by level: a node's
hash covers its children's numbers, offsets (from the node's beginning), lengths and hashes in order. So a range that is damaged, moved or
of another length differs, and so do all ranges above it; a record that is missing moves its later siblings, but not what is in
them. An audit compares two replicas' roots and descends only below nodes that differ; records under equal nodes are
sound without being compared. Leaves and the ranges above them are tables of their own, so the audit reads no leaf before it reaches them.

A leaf is all records of one file and number, in the order of their hashes: one as a rule; repeated rows, or rows of one id, share a leaf,
whose hash is that of their hashes, and its verdict. Files hold at most `fanout ** levels` numbers (those beyond form further trees of
the same file). Nulls: null urls and contents are empty; records without an id go to files of their own, dealt by hash, so many that
none holds more than a file does elsewhere. A leaf that one replica lacks is reported as missing or extra. An empty replica has no
roots: all records of the other are reported. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_CHARS, materialise, table, tidy

FANOUT, LEVELS = 16, 3
#: Fixed values of the rendering.
DATE, CRLF = "2024-01-01T00:00:00Z", "\r\n"


def record(ident: Column, url: Column, content: Column) -> Column:
    """A response record (WARC/1.0) with its closing blank lines."""
    body = F.coalesce(content, F.lit(""))
    head = ["WARC/1.0", CRLF, "WARC-Type: response", CRLF, "WARC-Record-ID: <urn:page:", F.coalesce(ident.cast("string"), F.lit("")), ">", CRLF, f"WARC-Date: {DATE}", CRLF, "WARC-Target-URI: ", F.coalesce(url, F.lit("")), CRLF, "Content-Type: text/html", CRLF, "Content-Length: ", F.octet_length(body).cast("string"), CRLF, CRLF]
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in head], body, F.lit(CRLF + CRLF))


def located(records: DataFrame) -> DataFrame:
    """records: file, number, record (text), and others. Adds offset (in the file), length and digest, and drops record."""
    per = FANOUT**LEVELS
    sized = records.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256)).drop("record").withColumn("_tree", F.floor(F.col("number") / per))
    before = F.sum("length").over(Window.partitionBy("file", "_tree").orderBy("number", "digest").rowsBetween(Window.unboundedPreceding, -1))
    trees = sized.groupBy("file", "_tree").agg(F.sum("length").alias("_n"))
    base = F.sum("_n").over(Window.partitionBy("file").orderBy("_tree").rowsBetween(Window.unboundedPreceding, -1))
    trees = trees.select(F.col("file").alias("_f"), F.col("_tree").alias("_t"), F.coalesce(base, F.lit(0)).alias("_base"))
    local = sized.withColumn("_in", F.coalesce(before, F.lit(0)))
    return local.join(trees, (F.col("file") == F.col("_f")) & (F.col("_tree") == F.col("_t"))).withColumn("offset", F.col("_in") + F.col("_base")).drop("_tree", "_in", "_f", "_t", "_base")


def leaves(records: DataFrame) -> DataFrame:
    """records: file, number, record (text), or located(). file, tree, at (the place in the tree), offset, length, digest of every leaf."""
    per = FANOUT**LEVELS
    found = (located(records) if "record" in records.columns else records).groupBy("file", "number").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sort_array(F.collect_list("digest")).alias("_d"))
    digest = F.when(F.size("_d") == 1, F.element_at("_d", 1)).otherwise(F.sha2(F.array_join("_d", ","), 256))
    return found.select("file", "number", F.floor(F.col("number") / per).alias("tree"), F.pmod(F.col("number"), F.lit(per)).alias("at"), "offset", "length", digest.alias("digest"))


def merkle(leaf: DataFrame) -> DataFrame:
    """file, tree, level (0: leaves), node, offset, length, digest of every node of every tree."""
    named = lambda level, i: level.withColumn("level", F.lit(i)).select("file", "tree", "level", "node", "offset", "length", "digest")
    level = materialise(leaf.select("file", "tree", F.col("at").alias("node"), "offset", "length", "digest"))
    out = named(level, 0)
    for i in range(1, LEVELS + 1):
        children = level.groupBy("file", "tree", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.min("offset").alias("first"), F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("node", "offset", F.col("length").alias("n"), "digest"))).alias("_c"))
        kids = F.array_join(F.transform("_c", lambda x: F.concat_ws(":", x["node"].cast("string"), (x["offset"] - F.col("first")).cast("string"), x["n"].cast("string"), x["digest"])), ",")
        level = children.select("file", "tree", F.col("up").alias("node"), F.col("first").alias("offset"), "length", F.sha2(kids, 256).alias("digest"))
        level = materialise(level) if i == 1 else level  # those above are a sixteenth of it and less
        out = out.unionByName(named(level, i))
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours, theirs: merkle() tables. The leaves below differing nodes: file, tree, node, verdict (changed, missing, extra), compared."""
    frontier = None
    for i in range(LEVELS, -1, -1):
        a = ours.where(F.col("level") == i).select("file", "tree", "node", F.struct("offset", "length", "digest").alias("a"))
        b = theirs.where(F.col("level") == i).select("file", "tree", "node", F.struct("offset", "length", "digest").alias("b"))
        if frontier is not None:  # children of nodes that differ only
            up = F.floor(F.col("node") / FANOUT).alias("_up")
            a, b = (x.withColumn("_up", up).join(frontier, ["file", "tree", "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.join(b, ["file", "tree", "node"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        if i:
            frontier = both.select("file", "tree", F.col("node").alias("_up"))
    return both.select("file", "tree", "node", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("verdict"))


def write_warc(records: DataFrame, path: str) -> None:
    """records: record. One uncompressed WARC file for each partition; the last line break of a record is the writer's."""
    records.select(F.expr("left(record, length(record) - 2)").alias("value")).write.option("lineSep", CRLF).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, whole (record), in no order, found by their Content-Length whatever they contain. A record that is
    shorter than its Content-Length says, or something else between records, raises an error. A task holds a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, out, size = content.as_py(), 0, [], 0
                while at < len(data):
                    body = data.find(b"\r\n\r\n", at) + 4
                    length = re.search(rb"\r\nContent-Length: *(\d+)", data[at:body])
                    if not data.startswith(b"WARC/1.0\r\n", at) or body < 4 or not length:
                        raise ValueError(f"no WARC record at {at}")
                    end = body + int(length[1])
                    if data[end : end + 4] != b"\r\n\r\n":
                        raise ValueError("a WARC record is cut short")
                    out.append(data[at : end + 4].decode())
                    at, size = end + 4, size + end - at
                    if size > SLICE_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), "record string")


def filed(pages: DataFrame, size: int = 1024) -> DataFrame:
    """pages with file and number: files of `size` page ids; pages without an id in files below 0, dealt by hash."""
    ids = F.col("page_id")
    nulls = pages.where(ids.isNull()).count()
    mark = F.xxhash64("url", "html")
    file = F.when(ids.isNull(), -1 - F.pmod(mark, F.lit(2 * nulls // size + 1))).otherwise(F.floor(ids / size))
    number = F.when(ids.isNull(), F.pmod(F.xxhash64(mark), F.lit(size))).otherwise(F.pmod(ids, F.lit(size)))
    return pages.withColumns({"file": file, "number": number})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, files of 1024 page ids, against a replica that is corrupt where page_id mod 97 is 5
    (its content ends in `?` in place) and lacks those where it is 7. One row per record, with what the audit found."""
    numbered = filed(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rest = F.coalesce(F.pmod("page_id", F.lit(97)), F.lit(0))
    whole = record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    ours = materialise(located(numbered.select("page_id", "file", "number", whole)))
    bad = F.when(rest == 5, F.concat(F.expr("left(coalesce(html, ''), greatest(length(html) - 1, 0))"), F.lit("?"))).otherwise(F.col("html"))
    theirs = numbered.where(rest != 7).select("file", "number", record(F.col("page_id"), F.col("url"), bad).alias("record"))
    found = audit(merkle(leaves(ours)), merkle(leaves(theirs)))
    found = found.select("file", (F.col("tree") * FANOUT**LEVELS + F.col("node")).alias("number"), "verdict")
    out = ours.join(found, ["file", "number"], "left")
    return out.select("page_id", F.col("file").alias("warc_file"), F.col("number").cast("long").alias("record_no"), F.col("offset").alias("record_offset"), "length", "digest", F.coalesce("verdict", F.lit("sound")).alias("verdict"))


ORACLE = r"""
WITH r AS (
  SELECT page_id, page_id // 1024 AS warc_file, page_id % 1024 AS record_no,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages)
SELECT page_id, warc_file, record_no,
       CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY record_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
       strlen(record) AS length, sha256(record) AS digest,
       CASE page_id % 97 WHEN 5 THEN 'changed' WHEN 7 THEN 'missing' ELSE 'sound' END AS verdict FROM r
"""
