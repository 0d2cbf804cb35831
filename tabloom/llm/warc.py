"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A reader that splits a file can't tell a record's first bytes from the same bytes inside a payload.  So every split emits each
place where the magic occurs as a candidate with the place where its record would end; the links are followed inside the splits,
pointer jumping from the start of every file finds where the chain enters each split, and only records on the chain remain.
The files are read and written by Spark's text source, whose line separator is a parameter, so splits, retries and stores are its concern.
"""

from __future__ import annotations

import contextlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.session import materialize

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"  # between header and payload, and after every record
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex40: Column) -> Column:
    """Base 32 (RFC 4648) of 20 bytes given as hexadecimal digits: ten of these are eight digits of base 32."""
    groups = [F.lpad(F.conv(F.substring(hex40, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE) -> None:
    """Writes a record per row of ``pages`` to WARC files in the folder ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest key is a response and the others revisit it;
    every other row is a response.  A NULL payload is empty, a NULL URL is left out.  Rows with a NULL key are responses without
    a page id.  Repeated rows of the smallest key are all responses.  Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.withColumn("d", F.sha1(F.col("p").cast("binary"))).withColumn("n", F.octet_length("p"))
    first = rows.where((F.col("n") >= least) & F.col("k").isNotNull()).groupBy("d").agg(F.min("k").alias("r"), F.max("k").alias("last")).where("r < last").select("d", "r")
    records = rows.join(materialize(first), "d", "left").withColumn("r", F.when((F.col("n") >= least) & (F.col("k") > F.col("r")), F.col("r")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    again = F.col("r").isNotNull()
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", page("k")),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("u", r"[\r\n]+", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("d")))),
        line("WARC-Profile", F.when(again, REVISIT)), line("WARC-Refers-To", page("r")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(again, 0).otherwise(F.col("n")).cast("string"), F.lit(GAP), F.when(again, "").otherwise(F.col("p")),
    )
    records.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, with the split they come from; ``turn`` ascends within a split."""
    seg = spark.read.option("lineSep", MAGIC).text(path)
    return seg.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per magic: ``file, block, offset``, the fields of the header behind it, and ``next``, where its record would end.

    ``sha1`` is the payload's if no further magic lies within it (``whole``).
    """
    head = F.substring_index("value", GAP, 1)
    field = lambda name, what: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*{what}[ \t]*$", 1), F.lit(""))
    end = F.octet_length(head) + 4
    seg = segments(spark, path).withColumns({"size": F.octet_length("value").cast("long"), "body": end.cast("long"), "length": field("Content-Length", r"(\d{1,18})").cast("long")})
    whole = F.col("body") + F.col("length") + 4 <= F.col("size")
    seg = seg.select(
        "file", "block", "turn", "size", "body", "length", whole.alias("whole"), field("WARC-Type", r"(\S+)").alias("type"),
        field("WARC-Record-ID", "<urn:page:(.*)>").alias("id"), field("WARC-Refers-To", "<urn:page:(.*)>").alias("refers"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("said"),
        F.when(whole, F.sha1(F.substring(F.col("value").cast("binary"), F.col("body") + 1, F.col("length")))).alias("sha1"),
    )
    return placed(materialize(seg))


def placed(seg: DataFrame) -> DataFrame:
    """``seg`` with ``offset`` (of the magic before the segment), ``next`` and ``nth`` (number of the segment in its split).

    The segments of a file lie end to end, so their places are running sums: of the splits, then inside each.
    """
    step = F.col("size") + len(MAGIC)
    splits = seg.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("turn")
    inside = seg.withColumn("ahead", F.coalesce(F.sum(step).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(within))
    out = inside.join(splits, ["file", "block"]).withColumn("offset", F.col("base") + F.col("ahead") - len(MAGIC)).drop("base", "ahead", "turn")
    return out.withColumn("next", F.col("offset") + len(MAGIC) + F.col("body") + F.col("length") + 4)


def _exits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For every candidate of a split, the first place of its chain that is no candidate of the split."""
    link = dict(zip(table["offset"].to_pylist(), table["next"].to_pylist(), strict=True))
    out: dict[int, int] = {}
    for at in sorted(link, reverse=True):
        out[at] = out.get(link[at], link[at])
    return pa.table({"file": pa.array([key[0].as_py()] * len(out), pa.string()), "offset": pa.array(list(out), pa.int64()), "exit": pa.array(list(out.values()), pa.int64())})


def _on_chain(key: tuple[pa.Scalar, ...], links: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of a split on the chain that starts at its entry."""
    link, found = dict(zip(links["offset"].to_pylist(), links["next"].to_pylist(), strict=True)), []
    for at in entries["entry"].to_pylist():
        while at in link:
            found.append(at)
            at = link[at]
    return pa.table({"file": pa.array([key[0].as_py()] * len(found), pa.string()), "offset": pa.array(found, pa.int64())})


def reachable(found: DataFrame) -> DataFrame:
    """``file, offset`` of the candidates that the chain of records from the start of their file visits."""
    links = found.where("next is not null").select("file", "block", "offset", "next")
    exits = materialize(links.groupBy("file", "block").applyInArrow(_exits, "file string, offset long, exit long"))
    starts = exits.where("offset = 0").select("file", "offset")
    nodes = exits.select("file", F.col("exit").alias("offset")).union(starts).distinct()
    jump = materialize(exits.join(nodes, ["file", "offset"]))
    reached, known = materialize(starts), -1
    while (n := reached.count()) > known:
        known = n
        there = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = materialize(reached.union(there).distinct())
        over = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("then"))
        jump = materialize(jump.join(over, ["file", "exit"], "left").select("file", "offset", F.coalesce("then", "exit").alias("exit")))
    entries = links.select("file", F.col("block").alias("split"), "offset").join(reached, ["file", "offset"]).select(F.col("file").alias("of"), "split", F.col("offset").alias("entry"))
    return links.groupBy("file", "block").cogroup(entries.groupBy("of", "split")).applyInArrow(_on_chain, "file string, offset long")


def _broken(spark: SparkSession, path: str, records: DataFrame, found: DataFrame) -> DataFrame:
    """``file, offset, sha1`` of the records whose payloads hold magics: their segments are read again and joined up."""
    parts = found.select("file", "block", "nth", F.col("offset").alias("at"), "size").alias("s").join(
        records.where("not whole").select("file", "offset", "next", "body", "length").alias("r"),
        (F.col("s.file") == F.col("r.file")) & (F.col("at") >= F.col("offset")) & (F.col("at") < F.col("next")),
    ).select("s.file", "block", "nth", "at", "offset", "body", "length")
    parts = materialize(parts)
    again = segments(spark, path).join(parts.select("file", "block").distinct(), ["file", "block"])
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("turn"))).drop("turn")
    pieces = again.join(parts, ["file", "block", "nth"]).groupBy("file", "offset", "body", "length").agg(F.sort_array(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("value")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.hex(x.value)), MAGIC.encode().hex().upper())
    return pieces.select("file", "offset", F.sha1(F.substring(F.unhex(text), F.col("body") + 1, F.col("length"))).alias("joined"))


@contextlib.contextmanager
def steady_splits(spark: SparkSession):
    """Until the end of the block, files are split alike in every read, however many executors come and go.

    Spark derives the size of splits from the cores that it has when a read is planned; a set number of them takes their place.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to`` of every record on the chain from the start of its file.

    Digests of responses are computed from the payloads that were read; a revisit has its own header's digest, and the length of the response
    with that digest under the id that it refers to (both NULL if there is none).  Bytes that no chain reaches, whatever they look like, are not
    records; where a header has no length, the chain ends.
    """
    with steady_splits(spark):
        found = materialize(candidates(spark, path))
        records = materialize(found.join(reachable(found), ["file", "offset"]))
        if not records.where("not whole").isEmpty():
            joined = materialize(_broken(spark, path, records, found))
            records = records.join(joined, ["file", "offset"], "left").withColumn("sha1", F.coalesce("joined", "sha1"))
            if not records.where("length is not null and sha1 is null").isEmpty():
                raise RuntimeError("the archives changed between two reads")
    own = records.select("id", "type", "refers", "said", F.col("length").alias("n"), base32(F.col("sha1")).alias("d"))
    full = own.where("type = 'response'").drop("said")
    seen = full.groupBy(F.col("id").alias("refers"), F.col("d").alias("said")).agg(F.max("n").alias("n"))
    again = own.where("type = 'revisit'").select("id", "type", "refers", "said").join(seen, ["refers", "said"], "left")
    again = again.select("id", "type", "refers", "n", F.when(F.col("n").isNotNull(), F.col("said")).alias("d"))
    return full.union(again).toDF("id", "record_type", "refers_to", "payload_bytes", "payload_digest").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
