"""WARC files written and read back, with magics inside payloads and splits smaller than records."""

import base64
import hashlib

import pytest

from tabloom.llm import warc
from tabloom.session import scratch_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["1500", "128m"])
def test_round_trip(spark, split):
    payloads = [None, "", "aé", FAKE, FAKE * 3 + "x", "WARC/1.0\r\n", FAKE + "\r\n\r\n" + FAKE, "same", "y" * 5000]
    rows = [(i, None if i % 7 == 0 else f"http://u/{i}", payloads[i % 9] if i % 4 else f"{i}", "extra") for i in range(70)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = scratch_path(spark, "warc")
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(3), path)
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html or "", i)
    want = set()
    for i, _, html, _ in rows:
        r = first[html or ""]
        want.add((str(i), len((html or "").encode()), digest(html or ""), "response" if r == i else "revisit", None if r == i else str(r)))
    assert len(got) == 70 and {tuple(x) for x in got} == want


def test_repeated_rows_null_keys_and_least_size(spark):
    rows = [(1, "u", "abc"), (1, "u", "abc"), (2, "u", "abc"), (None, "u", "abc"), (3, "u", "z"), (4, "u", "z")]
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least=2)
    got = sorted((x.id or "", x.record_type, x.refers_to or "", x.payload_bytes) for x in warc.read_warc(spark, path).collect())
    assert got == [("", "response", "", 3), ("1", "response", "", 3), ("1", "response", "", 3), ("2", "revisit", "1", 3), ("3", "response", "", 1), ("4", "response", "", 1)]


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_base32(spark):
    texts = ["", "a", "warc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(warc.base32(F.sha1("t"))).collect()] == [digest(t) for t in texts]
