"""Content-addressed WARC archive.

Two Parquet tables in the shared folder: the payload bytes, stored once under their SHA-256, and one row per record with
its exact header block and the digest of its payload. Writing refuses a digest whose payloads differ in length or SHA-1;
reading computes the digest of every payload again and refuses any that does not match. Records are put together by a
join on the digest; the rows of a payload that many records share are only headers.

Defined results: a null payload is empty; a null URL has no target line; line breaks in a URL are percent-encoded; of
records with equal payloads that with the smallest id is the response (null ids come last, a repeated row of the response
is a response too) and the others revisit it; payloads below the minimum size are all responses; an empty table gives an
empty archive; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import same

#: base32 digits in the order of their values, next to those that ``conv`` writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2000-01-01T00:00:00Z"
END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32: every five hexadecimal digits are four base32 digits."""
    digest = F.sha1(data)
    quarters = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quarters), CONV32, BASE32)


def record_name(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


@dataclass(frozen=True)
class Archive:
    """Where the two tables are, and the type of the record ids."""

    headers: str
    payloads: str
    id_type: str


def write_archive(records: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 0, path: str | None = None, date: str = DATE) -> Archive:
    """Write one record per row; ``path`` defaults to a new folder in the shared scratch folder."""
    spark = records.sparkSession
    path = path or scratch_path(spark, "warc")
    archive = Archive(f"{path}/headers", f"{path}/payloads", records.schema[record_id].dataType.simpleString())
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = records.select(F.col(f"`{record_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), data.alias("payload"))
    # the digest is computed before any join, so that no shuffle carries a payload only to hash it
    described = rows.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"),
                            base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    described.write.mode("error").parquet(f"{path}/described")
    described = spark.read.schema(described.schema).parquet(f"{path}/described")
    firsts = described.groupBy("digest").agg(
        F.min("id").alias("first"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"))
    clash = (F.col("n0") != F.col("n1")) | (F.col("s0") != F.col("s1"))
    firsts = firsts.select(F.col("digest").alias("d"), F.when(
        clash, F.raise_error(F.lit("payloads of one digest differ")).cast(firsts.schema["first"].dataType)
    ).otherwise(F.col("first")).alias("first"))
    joined = described.join(firsts, F.col("digest") == F.col("d"))
    revisit = (F.col("n") >= min_bytes) & ~same(F.col("id"), F.col("first"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = F.array_compact(F.array(
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_name(F.col("first")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    ))
    header = F.concat(F.array_join(lines, END), F.lit(END + END)).cast("binary")
    joined.select(header.alias("header"), "digest").write.mode("error").parquet(archive.headers)
    # equal digests were found to have equal payloads, so any of them is the one to keep; copies meet before the shuffle
    stored = rows.groupBy(F.unhex(F.sha2("payload", 256)).alias("digest")).agg(F.any_value("payload").alias("payload"))
    stored.write.mode("error").parquet(archive.payloads)
    return archive


def header_field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """``id record_type refers_to target header payload record``: every record with its whole payload.

    ``record`` is the record as a WARC file holds it: header block, content block (empty for a revisit), two line ends.
    """
    headers = spark.read.schema("header binary, digest binary").parquet(archive.headers)
    payloads = spark.read.schema("digest binary, payload binary").parquet(archive.payloads).withColumnRenamed("digest", "d")
    text = F.decode("header", "UTF-8")
    name = r"^<urn:record:(.*)>$"

    def number(field: str) -> Column:
        found = F.regexp_extract(header_field(text, field), name, 1)
        return F.when(found != "", found).cast(archive.id_type)

    joined = headers.join(payloads, F.col("digest") == F.col("d"), "left")
    whole = F.col("payload").isNotNull() & (F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (
        header_field(text, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))))
    payload = F.when(whole, F.col("payload")).otherwise(
        F.raise_error(F.lit("a payload is missing or does not match its digest")).cast("binary"))
    kind = header_field(text, "WARC-Type")
    end = F.lit(END + END).cast("binary")
    return joined.select(
        number("WARC-Record-ID").alias("id"), kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        header_field(text, "WARC-Target-URI").alias("target"), "header", payload.alias("payload"),
    ).withColumn("record", F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(
        F.concat("header", "payload", end)))


def archive_report(records: DataFrame, record_id: str = "page_id", **options) -> DataFrame:
    """Write the archive, read it back: id, payload size and digest, record type and what a revisit refers to."""
    archive = write_archive(records, record_id, **options)
    return read_archive(records.sparkSession, archive).select(
        F.col("id").alias(record_id), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


ORACLE = f"""
WITH described AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
  SELECT page_id, payload, list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)),
    'string_agg', '') AS payload_digest FROM described),
firsts AS (SELECT payload, min(page_id) AS first FROM digests GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digests JOIN firsts USING (payload)"""
