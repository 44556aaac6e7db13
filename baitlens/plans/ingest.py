"""From files in any format to stored splits: one job, no local state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import ingest_label
from ..operators.dedup import first_per_key
from ..operators.ordering import with_rank
from ..operators.splits import stratified_split, synthetic_time
from ..session import materialise
from ..sources.readers import Ingested, ingest
from ..sources.writers import write_splits

CANONICAL = {"label": "string", "text": "string", "url": "string", "timestamp": "timestamp_ntz"}


def labelled_rows(found: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``label text url timestamp source_place``: rows whose label is understood and that have a text or a URL."""
    columns = [F.col(c).try_cast(kind).alias(c) if c in found.columns else F.lit(None).cast(kind).alias(c) for c, kind in CANONICAL.items()]
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source_file")) if sources else F.lit(0)
    rows = found.select(*columns, order.alias("source_place")).withColumn("label", ingest_label(F.col("label")))
    says_something = (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.trim(F.coalesce("url", F.lit(""))) != "")
    return rows.where(F.col("label").isNotNull() & says_something)


def prepared_rows(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``row_id label text url timestamp split``.

    Of rows with equal text and URL the one of the earliest source stays, then the smaller label. Ids follow the content,
    so the same rows give the same ids whatever files they came in; a missing time is one hour per id.
    """
    ordered = rows.withColumn("_order", F.struct("source_place", "label", "timestamp"))
    single = first_per_key(ordered, ["text", "url"], "_order").drop("_order", "source_place")
    numbered = materialise(with_rank(single, ["text", "url"], "row_id"), "ingest-rows")
    timed = synthetic_time(numbered, "row_id", "_synthetic").withColumn("timestamp", F.coalesce("timestamp", "_synthetic")).drop("_synthetic")
    return stratified_split(timed, "row_id", "label", seed=seed).select("row_id", "label", "text", "url", "timestamp", "split")


def ingest_to_splits(spark: SparkSession, paths: Sequence[str], target: str, seed: int = 42) -> Ingested:
    """Read every source, keep what can be used, split it and write it below ``target``; the table is what was written."""
    found = ingest(spark, paths)
    if found.table is None:
        return found
    write_splits(prepared_rows(labelled_rows(found.table, found.used), seed), target)
    return Ingested(spark.read.parquet(target), found.used, found.skipped)
