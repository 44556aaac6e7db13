import base64
import hashlib

import pytest
from check_queries import compare, connect
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from baitlens.llm import warc_archive as w

SCHEMA = "page_id long, url string, html string"
ROWS = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (1, "http://c/", None), (4, "http://d/", ""), (7, "é", "WARC/1.0\r\n\r\né"),
        (8, "http://e/", "x" * 300_000), (None, "http://f/", "same"), (None, "http://g/", "only"), (2, "http://b/\r\nX: y", "same")]


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        home = first.get(html or "")
        revisit = len(data) >= least and page != home
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", home if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 3, 5])
def test_report_equals_brute_force(spark, clashing, least):
    frame = clashing(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "digest", "payload", "first", "id")
    assert sorted(str(tuple(r)) for r in w.archive_report(frame, min_bytes=least).collect()) == brute(ROWS, least)


def test_records_read_back_whole(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS, SCHEMA))
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[2] or "" for r in ROWS})
    for r in w.read_archive(spark, archive).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        payload = bytes(r["payload"])
        assert head.startswith(b"WARC/1.0") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == (payload if r["record_type"] == "response" else b"") and int(fields[b"Content-Length"]) == len(body) - 4
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
        assert (b"WARC-Refers-To" in fields) == (r["refers_to"] is not None)


def test_a_damaged_payload_is_refused(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS, SCHEMA))
    bad = spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad.write.parquet(archive.payloads + "-bad")
    with pytest.raises(PySparkException, match="does not match"):
        w.read_archive(spark, w.Archive(archive.headers, archive.payloads + "-bad", "bigint")).collect()
    spark.read.parquet(archive.payloads).limit(1).write.parquet(archive.payloads + "-few")
    with pytest.raises(PySparkException, match="missing"):
        w.read_archive(spark, w.Archive(archive.headers, archive.payloads + "-few", "bigint")).collect()


def test_empty_table(spark):
    assert w.archive_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf):
    assert compare(spark, connect(sf), "op10_warc_archive", sf)[0] == "ok"
