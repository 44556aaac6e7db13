"""Streaming queries over the events; each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..session import read_table, scratch_path
from ..sources.writers import read_history
from ..streaming import jobs
from .base import finish, outputs, query
from .numeric import EVENTS_SQL, FEATURES, JS_SQL, NEW_SQL, events, psi_sql


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = read_table(spark, sf, "events").schema
    stream = jobs.file_stream(spark, sf, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, name), scratch_path(spark, f"{name}-log")


@query("stream_scoring", """
WITH s AS (SELECT event_id, least(1.0, value / 40.0::DOUBLE) AS score FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, round(score, 6) + 0.0 AS score, CAST(CASE WHEN score <= 0.45::DOUBLE THEN 0 WHEN score >= 0.55::DOUBLE THEN 1 ELSE -1 END AS BIGINT) AS verdict FROM s""")
def stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    scored = jobs.score_stream(event_stream(spark, sf), lambda df: df.withColumn("score", F.least(F.lit(1.0), F.col("value") / 40.0)))
    return finish(jobs.run_to_table(scored.select("event_id", "score", "verdict"), *_paths(spark, "stream-scores")))


@query("stream_counters", """
WITH x AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS total_predictions, count(*) FILTER (WHERE event_type = 'error') AS phishing_detected,
  count(*) FILTER (WHERE event_type <> 'error') AS safe_count, sum(value) AS latency_sum FROM events GROUP BY 1) """
       f"SELECT {outputs('window_start:s total_predictions:i phishing_detected:i safe_count:i latency_sum:d', 4)} FROM x")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    stream = event_stream(spark, sf).withColumn("hit", (F.col("event_type") == "error").cast("int"))
    counted = jobs.windowed_counters(stream, "ts", "hit", "value")
    table = jobs.upserts_to_table(counted, *_paths(spark, "stream-counters"), keys=["window_start"])
    return finish(table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each content once: the watermark covers the whole stream."""
    stream = event_stream(spark, sf).select("ts", "user_id", "event_type")
    kept = jobs.dedupe_stream(stream, "ts", "60 days")
    return finish(jobs.run_to_table(kept.select("user_id", "event_type"), *_paths(spark, "stream-dedupe")))


@query("stream_drift_windows", f"""
WITH {EVENTS_SQL}, nl AS (SELECT feature, value, CAST(ts AS DATE) AS day FROM long WHERE NOT base), {psi_sql('day')}
SELECT CAST(day AS TIMESTAMP) AS window_start, feature, round(psi, 6) + 0.0 AS psi FROM psi""")
def stream_drift_windows(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    baseline = dr.establish_baseline(base, FEATURES).cache()
    path, log = _paths(spark, "stream-new")
    new.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    stream = jobs.file_stream(spark, path, spark.read.parquet(path).schema)
    binned = jobs.windowed_bins(stream, baseline, "ts", FEATURES)
    table = jobs.upserts_to_table(binned, *_paths(spark, "stream-bins"), keys=["window_start", "feature", "bin"])
    psi = jobs.psi_of_bins(table, baseline)
    return finish(psi.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("stream_drift", f"""
WITH {EVENTS_SQL}, {NEW_SQL}, {psi_sql()}, {JS_SQL.replace(" AND event_type <> 'signup'", '')},
x AS (SELECT (SELECT avg(psi) FROM psi) AS psi_mean, js_divergence FROM js),
y AS (SELECT *, 0.5 * psi_mean + 0.2 * js_divergence / ln(2) AS overall_drift_score FROM x)
SELECT {outputs('psi_mean:d js_divergence:d overall_drift_score:d')}, CAST(overall_drift_score > 0.1 AS BIGINT) AS alert_triggered FROM y""")
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A report per micro-batch in the history."""
    base, new = events(spark, sf)
    path, history = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-history")
    new.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    stream = jobs.file_stream(spark, path, spark.read.parquet(path).schema)
    jobs.drift_per_batch(stream, dr.establish_baseline(base, FEATURES), history, scratch_path(spark, "stream-history-log"),
                         dr.label_shares(base, "event_type"), "event_type")
    last = dr.last_record(read_history(spark, history))
    return finish(last.select("psi_mean", "js_divergence", "overall_drift_score", "alert_triggered"))
