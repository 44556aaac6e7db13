"""Readers for labelled message and URL files; everything is read as text columns unless a schema is given."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.dedup import union_by_name
from ..operators.schema import (
    drop_unnamed,
    first_of_duplicate_columns,
    lower_names,
    standardise_columns,
    synthesise_text,
)

CORPUS_NAME = "smsspamcollection"
EXTENSIONS = ("csv", "tsv", "jsonl", "json", "parquet")
FALLBACK_ENCODING = "ISO-8859-1"
_SURPLUS = "_surplus"
#: Error conditions that mean a source's content cannot be read; every other error stops the job.
MISSING = "PATH_NOT_FOUND"
UNREADABLE = (MISSING, "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "MALFORMED_RECORD_IN_PARSING")


class NoReader(ValueError):
    """A file whose name no reader takes."""


def unreadable(error: Exception) -> str | None:
    """The condition of an error that only says that content is missing or broken, else None."""
    if isinstance(error, NoReader):
        return "NO_READER"
    if isinstance(error, PySparkException):
        named = [error.getCondition() or ""]
    else:
        # an error inside a task arrives as the JVM's; conditions stand in brackets before its message and those of its causes
        named = re.findall(r"\[([A-Z_]+(?:\.[A-Z_]+)?)\]", str(error)) if isinstance(error, Py4JJavaError) else []
    return next((c for c in named if c.split(".")[0] in UNREADABLE), None)


def text_encoding(spark: SparkSession, path: str | Sequence[str]) -> str:
    """UTF-8, or Latin-1 where a line is not valid UTF-8 (one scan that stops at the first such line)."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    broken = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return FALLBACK_ENCODING if broken else "UTF-8"


def _text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: StructType | None = None,
                   encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header. Lines with too many fields are skipped, missing fields are null.

    ``multi_line=False`` lets Spark split large files when no quoted field holds a line break.
    """
    options = {"header": True, "sep": sep, "encoding": encoding or text_encoding(spark, path), "escape": '"',
               "multiLine": multi_line}
    if schema is None:
        schema = _text_schema(spark.read.options(**options).csv(path).columns)
    # one column more than the header: it is filled only by a line with too many fields
    wide = StructType([*schema.fields, StructField(_SURPLUS, StringType())])
    rows = spark.read.options(**options, mode="PERMISSIVE").schema(wide).csv(path)
    return rows.where(F.col(_SURPLUS).isNull()).drop(_SURPLUS)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Header-less two-column corpus: label and text."""
    return spark.read.schema("label STRING, text STRING").options(
        sep="\t", encoding=text_encoding(spark, path)).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object per line; unreadable lines are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file name."""
    folder, _, name = path.rstrip("/").lower().rpartition("/")
    plain = name.removesuffix(".gz")
    if folder.endswith(".jsonl"):  # a part file of JSON lines, whatever its own name
        return read_json_lines(spark, path)
    if plain == CORPUS_NAME:
        return read_corpus(spark, path)
    readers = {".csv": read_csv, ".tsv": read_tsv, ".jsonl": read_json_lines, ".json": read_json_document,
               ".parquet": read_parquet}
    for suffix, reader in readers.items():
        if plain.endswith(suffix):
            return reader(spark, path)
    raise NoReader(f"no reader for {path}")


def discover(spark: SparkSession, roots: Sequence[str], override: str | None = None) -> list[str]:
    """Readable files below the roots, each path once; an override root (argument or DATA_DIR) comes first."""
    wanted = [r for r in (override or os.environ.get("DATA_DIR"), *roots) if r]
    pattern = "*.{" + ",".join([*EXTENSIONS, *[f"{e}.gz" for e in EXTENSIONS]]) + "}"
    found: dict[str, None] = {}
    for root in wanted:
        for glob in (pattern, "*[sS][mM][sS][sS][pP][aA][mM]*"):
            try:
                # only the path column is asked for, so no file content is read
                files = (
                    spark.read.format("binaryFile").option("recursiveFileLookup", True)
                    .option("pathGlobFilter", glob).load(root).select("path").orderBy("path").collect()
                )
            except AnalysisException as error:
                if error.getCondition() != MISSING:  # a missing root is not an error
                    raise
                continue
            found.update(dict.fromkeys(r["path"] for r in files))
    return list(found)


@dataclass
class Ingested:
    table: DataFrame | None
    used: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)


def ingest(spark: SparkSession, paths: Sequence[str]) -> Ingested:
    """Read each source, bring its columns to the canonical names, and union them.

    A source whose content cannot be read is skipped and named with the error's condition; any other error is raised, so that
    a lost executor or a full disk never looks like a broken file.
    """
    frames, used, skipped = [], [], {}
    for path in dict.fromkeys(paths):
        try:
            raw = read_any(spark, path)
            frame = lower_names(first_of_duplicate_columns(drop_unnamed(raw)))
            frame = synthesise_text(standardise_columns(first_of_duplicate_columns(frame)))
            frame = frame.withColumn("source_file", F.lit(path))
            frame.limit(1).collect()
            frames.append(frame)
            used.append(path)
        except Exception as error:
            reason = unreadable(error)
            if reason is None:
                raise
            skipped[path] = reason
    if not frames:
        return Ingested(None, used, skipped)
    return Ingested(union_by_name(*_same_types(frames)), used, skipped)


def _same_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns whose type differs between sources are united as text."""
    kinds: dict[str, set] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    return [f.withColumns({n: F.col(n).cast("string") for n in f.columns if n in mixed}) for f in frames]
