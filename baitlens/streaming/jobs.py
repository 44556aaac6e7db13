"""Continuous jobs: scoring, counters, drift, de-duplication. Everything but the sinks is shared with batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.probability import verdict
from ..operators.dedup import content_hash
from ..operators.drift import bin_index, dense_counts, drift_report, feature_values, psi
from ..session import broadcast_if_small
from ..sources.writers import append_history


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available now into Parquet and read it back."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float = 0.5,
                 band: float = 0.05) -> DataFrame:
    """Score and decide row by row (append output)."""
    return scorer(stream).withColumn("verdict", verdict(F.col("score"), threshold, band))


def windowed_counters(stream: DataFrame, ts: str, flagged: str, latency: str, window: str = "1 hour",
                      late: str = "2 hours") -> DataFrame:
    """Totals, positives and mean latency per tumbling window under a watermark."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("total_predictions"), F.count_if(F.col(flagged) == 1).alias("phishing_detected"),
             F.count_if(F.col(flagged) == 0).alias("safe_count"), F.sum(latency).alias("latency_sum"))
        .select(F.col("w.start").alias("window_start"), "total_predictions", "phishing_detected", "safe_count",
                "latency_sum")
    )


def upserts_to_table(updates: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode aggregates as an append-only log with the batch number; the latest state of each key is read."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(path)

    query = (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    log = updates.sparkSession.read.parquet(path)
    rest = [c for c in updates.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def dedupe_stream(stream: DataFrame, ts: str, late: str = "2 hours", ignore: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose content was seen within the watermark."""
    hashed = content_hash(stream, ignore=(ts, *ignore), name="_hash")
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def drift_per_batch(stream: DataFrame, baseline: DataFrame, history: str, checkpoint: str,
                    baseline_labels: DataFrame | None = None, label: str | None = None) -> None:
    """A drift report against the frozen baseline for every micro-batch, appended to the history."""
    def check(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            append_history(drift_report(baseline, batch, baseline_labels, label), history, batch=batch_id)

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(check).start()
    )
    query.awaitTermination()


def windowed_bins(stream: DataFrame, baseline: DataFrame, ts: str, features: Sequence[str], window: str = "1 day",
                  late: str = "2 hours", bins: int = 10) -> DataFrame:
    """Counts per tumbling window, feature and frozen bin (update output); bin -1 collects what is outside."""
    edges = broadcast_if_small(baseline.select("feature", "edges"))
    index = F.coalesce(bin_index(F.col("value"), F.col("edges"), bins), F.lit(-1))
    long = feature_values(stream, features, [ts]).join(edges, "feature")
    return (
        long.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "feature", index.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "feature", "bin", "n")
    )


def psi_of_bins(binned: DataFrame, baseline: DataFrame, bins: int = 10) -> DataFrame:
    """PSI per window and feature from the windowed bin counts."""
    inside = F.when(F.col("bin") >= 0, F.struct("bin", "n"))
    per_window = binned.groupBy("window_start", "feature").agg(F.collect_list(inside).alias("_e")).withColumn(
        "_new", dense_counts(bins, F.col("_e")))
    joined = per_window.join(broadcast_if_small(baseline.select("feature", "counts")), "feature")
    return joined.select("window_start", "feature", psi(F.col("counts"), F.col("_new")).alias("psi"))
