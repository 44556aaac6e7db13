"""Round trips through every file format, discovery, and skipping of unreadable rows and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import ingest_to_splits as ingest_job
from ..session import read_table, scratch_path
from ..sources import readers as rd
from ..sources import writers as wr
from ..sources.delimited import read_blocks
from .base import finish, query, split_column, split_sql

DOCS = "doc_id string, text string, lang string, source string"
DOCS_SQL = "SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM documents"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")


def _back(df: DataFrame) -> DataFrame:
    return finish(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source"))


@query("io_roundtrip_csv", DOCS_SQL)
def io_roundtrip_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "docs") + ".csv"
    _documents(spark, sf).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return _back(rd.read_any(spark, path))


@query("io_roundtrip_tsv", DOCS_SQL)
def io_roundtrip_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "docs") + ".tsv"
    _documents(spark, sf).write.options(header=True, sep="\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return _back(rd.read_any(spark, path))


@query("io_csv_blocks", """
SELECT CAST(page_id AS BIGINT) AS page_id, url, replace(html, '>', '>' || chr(10)) AS html FROM pages""")
def io_csv_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a line break behind every tag, written as quoted fields and read back in blocks."""
    path = scratch_path(spark, "pages") + ".csv"
    pages = read_table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit(">"), F.lit(">\n")).alias("html"))
    pages.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = read_blocks(spark, path)
    return finish(back.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))


@query("io_roundtrip_corpus", "SELECT CASE WHEN event_type = 'error' THEN 'spam' ELSE 'ham' END AS label, event_type || ' ' || props AS text FROM events")
def io_roundtrip_corpus(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "corpus") + "/SMSSpamCollection"
    events = read_table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "spam").otherwise("ham").alias("label"), F.concat_ws(" ", "event_type", "props").alias("text"))
    events.write.options(sep="\t", quote="\x00").csv(folder)
    return rd.read_any(spark, folder)


@query("io_roundtrip_jsonl", DOCS_SQL)
def io_roundtrip_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "docs") + ".jsonl"
    _documents(spark, sf).write.json(path)
    return _back(rd.read_json_lines(spark, path, DOCS))


@query("io_roundtrip_json", DOCS_SQL)
def io_roundtrip_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON array per file, read as documents."""
    path = wr.write_json_documents(_documents(spark, sf), scratch_path(spark, "docs") + ".json", 8)
    return _back(rd.read_json_document(spark, path, DOCS))


@query("io_roundtrip_parquet", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, {split_sql('doc_id')} AS split FROM documents")
def io_roundtrip_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """Splits stored as one table partitioned by split; the second call reuses them."""
    path = scratch_path(spark, "splits")
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source").withColumn("split", split_column("doc_id"))
    wr.existing_or_prepare(spark, path, lambda: docs)
    return finish(wr.existing_or_prepare(spark, path, lambda: docs.limit(0)))


@query("io_skip_bad_rows", """
SELECT CAST(page_id AS BIGINT) AS page_id, url, 'jsonl' AS kind FROM pages
UNION ALL SELECT CAST(page_id AS BIGINT), url, 'csv' FROM pages""")
def io_skip_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every page once, plus a broken line for every page, in both text formats."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    lines = scratch_path(spark, "pages") + ".jsonl"
    good = F.to_json(F.struct("page_id", "url"))
    pages.select(F.explode(F.array(good, F.concat(F.lit("{broken "), "url"))).alias("value")).write.text(lines)
    rows = scratch_path(spark, "pages") + ".csv"
    line = F.concat_ws(",", F.col("page_id").cast("string"), "url")
    body = pages.select(F.explode(F.array(line, F.concat(line, F.lit(",surplus,fields")))).alias("value"))
    body.write.option("lineSep", "\n").text(rows)
    from_json = rd.read_json_lines(spark, lines, "page_id bigint, url string").withColumn("kind", F.lit("jsonl"))
    from_csv = spark.read.schema("page_id bigint, url string, _surplus string").csv(rows).where("_surplus IS NULL").drop("_surplus")
    return finish(from_json.unionByName(from_csv.withColumn("kind", F.lit("csv"))))


@query("io_discovery", """
WITH p AS (SELECT count(*) AS n, count(page_id) AS labels, count(url) AS urls FROM pages),
d AS (SELECT count(*) AS n, count(source) AS labels, count(text) AS texts FROM documents)
SELECT CAST(p.n + d.n AS BIGINT) AS n_rows, CAST(p.labels + d.labels AS BIGINT) AS n_label, CAST(p.n + d.texts AS BIGINT) AS n_text,
  CAST(p.urls AS BIGINT) AS n_url, CAST(1 AS BIGINT) AS n_files_unique, CAST(1 AS BIGINT) AS n_skipped FROM p, d""")
def io_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per canonical column after discovering a folder twice; one source cannot be read."""
    root = scratch_path(spark, "roots")
    pages = read_table(spark, sf, "pages")
    pages.select(F.col("page_id").alias("Label"), F.col("url").alias("Link")).write.options(header=True).csv(f"{root}/a.csv")
    read_table(spark, sf, "documents").select(F.col("source").alias("class"), F.col("text").alias("body")).write.json(f"{root}/b.jsonl")
    paths = rd.discover(spark, [root, root])
    found = rd.ingest(spark, [*paths, f"{root}/missing.parquet"])
    counts = found.table.agg(F.count("*").alias("n_rows"), F.count("label").alias("n_label"), F.count("text").alias("n_text"), F.count("url").alias("n_url"))
    return finish(counts.withColumns({"n_files_unique": F.lit(len(paths) == len(set(paths))), "n_skipped": F.lit(len(found.skipped))}))


INGEST_SQL = """
raw AS (
  SELECT 1 AS place, CASE WHEN quality = 1 THEN 'legitimate' WHEN toxic = 1 THEN 'phishing' ELSE 'unsure' END AS word, text, CAST(NULL AS VARCHAR) AS url
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 2, CASE WHEN page_id % 3 = 0 THEN 'malicious' ELSE 'benign' END, url, url FROM pages
  UNION ALL SELECT 3, CASE WHEN turn % 2 = 0 THEN 'ham' ELSE 'spam' END, text, NULL FROM conversations),
marked AS (SELECT place, CASE word WHEN 'legitimate' THEN 0 WHEN 'benign' THEN 0 WHEN 'ham' THEN 0 WHEN 'unsure' THEN NULL ELSE 1 END AS label, text, url FROM raw
  WHERE trim(coalesce(text, '')) <> ''),
single AS (SELECT text, url, arg_min(label, place * 2 + label) AS label FROM marked WHERE label IS NOT NULL GROUP BY text, url),
numbered AS (SELECT *, row_number() OVER (ORDER BY text NULLS FIRST, url NULLS FIRST) AS row_id FROM single),
dealt AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS pos, count(*) OVER (PARTITION BY label) AS size FROM numbered)"""


@query("ingest_to_splits", f"""
WITH {INGEST_SQL}
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(label AS BIGINT) AS label, md5(text) AS text_md5, url, TIMESTAMP '2024-01-01' + to_hours(CAST(row_id - 1 AS INTEGER)) AS timestamp,
  CASE WHEN pos <= round(size * 0.7::DOUBLE) THEN 'train' WHEN pos <= round(size * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM dealt""")
def ingest_to_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, pages and conversations written in three formats, then ingested, split and stored."""
    root = scratch_path(spark, "ingest")
    docs = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    word = F.when(F.col("quality") == 1, "legitimate").when(F.col("toxic") == 1, "phishing").otherwise("unsure")
    docs.select(word.alias("class"), F.col("text").alias("body")).write.parquet(f"{root}/a.parquet")
    pages = read_table(spark, sf, "pages")
    pages.select(F.when(F.col("page_id") % 3 == 0, "malicious").otherwise("benign").alias("Label"), F.col("url").alias("Link")).write.options(
        header=True).csv(f"{root}/b.csv")
    talks = read_table(spark, sf, "conversations")
    talks.select(F.when(F.col("turn") % 2 == 0, "ham").otherwise("spam").alias("label"), F.col("text").alias("message")).write.json(f"{root}/c.jsonl")
    stored = ingest_job(spark, [f"{root}/a.parquet", f"{root}/b.csv", f"{root}/c.jsonl"], f"{root}/splits").table
    return finish(stored.select("row_id", "label", F.md5("text").alias("text_md5"), "url", "timestamp", "split"))
