"""Sinks: splits, result tables, drift history, diagnostics, fitted artefacts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import BASELINE_SCHEMA
from ..operators.explain import error_rows, group_stats
from ..operators.profile import Profile
from .readers import read_csv

#: Bytes of a JSON document, which one task writes and reads.
FILE_BYTES = 64 << 20

REPORT_SCHEMA = (
    "ts timestamp, psi_mean double, psi_scores map<string,double>, drifted_features array<string>, "
    "feature_drift array<struct<feature:string,z_score:double,new_mean:double,baseline_mean:double>>, "
    "js_divergence double, baseline_accuracy double, new_accuracy double, accuracy_degradation double, "
    "overall_drift_score double, alert_triggered boolean"
)


@dataclass
class Manifest:
    """Job configuration of a data set: where the splits are, the target, the text columns."""

    train: str
    val: str
    test: str
    target: str = "label"
    text_columns: dict[str, str] = field(default_factory=lambda: {"url": "url", "subject": "subject", "body": "body"})

    @staticmethod
    def load(path: str) -> Manifest:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        return Manifest(
            raw["train_csv"], raw["val_csv"], raw["test_csv"], raw.get("target_col", "label"),
            dict(raw.get("text_cols", {"url": "url", "subject": "subject", "body": "body"})),
        )

    def save(self, path: str) -> None:
        raw = {"train_csv": self.train, "val_csv": self.val, "test_csv": self.test, "target_col": self.target,
               "text_cols": self.text_columns}
        Path(path).write_text(json.dumps(raw, indent=1), encoding="utf-8")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet", mode: str = "overwrite") -> str:
    """One table partitioned by split, so that a filter on the split prunes files."""
    writer = df.write.mode(mode).partitionBy(split)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)
    return path


def existing_or_prepare(spark: SparkSession, path: str, prepare, split: str = "split", force: bool = False) -> DataFrame:
    """Reuse the stored splits; otherwise prepare and store them."""
    if force or not path_exists(spark, path):
        write_splits(prepare(), path, split)
    return spark.read.parquet(path)


def save_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One Parquet folder per result table."""
    written = []
    for name, table in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        table.write.mode("overwrite").parquet(target)
        written.append(target)
    return written


def save_artifacts(folder: str, model: PipelineModel, profile: Profile | None, settings: dict,
                   tables: dict[str, DataFrame] | None = None, spark: SparkSession | None = None) -> None:
    """Model, profile table, settings (threshold, band, metadata) and result tables below one folder."""
    session = spark or SparkSession.getActiveSession()
    model.write().overwrite().save(f"{folder}/model")
    if profile is not None:
        profile.to_table(session).coalesce(1).write.mode("overwrite").parquet(f"{folder}/profile")
    session.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").text(
        f"{folder}/settings")
    save_tables(tables or {}, f"{folder}/tables")


@dataclass
class Artifacts:
    model: PipelineModel
    profile: Profile | None
    settings: dict

    @property
    def threshold(self) -> float:
        return float(self.settings.get("best_threshold", 0.5))

    @property
    def abstain_band(self) -> float:
        return float(self.settings.get("abstain_band", 0.05))


def load_artifacts(spark: SparkSession, folder: str) -> Artifacts:
    profile = None
    if path_exists(spark, f"{folder}/profile"):
        profile = Profile.from_table(spark.read.parquet(f"{folder}/profile"))
    settings = json.loads(spark.read.text(f"{folder}/settings").first()["value"])
    return Artifacts(PipelineModel.load(f"{folder}/model"), profile, settings)


def write_json_documents(df: DataFrame, path: str, files: int) -> str:
    """Each output file is one JSON array, written row by row; at least ``files``, more where one would exceed :data:`FILE_BYTES`."""
    def lines(batches):
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        started = False
        for batch in batches:
            if batch.num_rows and not started:
                # every row brings the comma before it, but for the first of the file
                first = pa.array([batch.column(0)[0].as_py()[1:]], pa.string())
                yield pa.RecordBatch.from_arrays([first], names=["value"])
                batch, started = batch.slice(1), True
            yield batch
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows = df.select(F.concat(F.lit(","), F.to_json(F.struct(*df.columns))).alias("value"))
    size = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    rows.repartition(max(files, 1 + int(size) // FILE_BYTES)).mapInArrow(lines, "value string").write.text(path)
    return path


def append_history(report: DataFrame, path: str, ts=None, batch: int | None = None) -> None:
    """Append a drift report with its time to the history.

    A numbered batch has a folder of its own, so a batch that is tried again replaces its record.
    """
    stamped = report.withColumn("ts", F.current_timestamp() if ts is None else ts)
    if batch is None:
        stamped.write.mode("append").json(f"{path}/batch=none")
    else:
        stamped.write.mode("overwrite").json(f"{path}/batch={batch}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def save_baseline(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_SCHEMA).json(path)


def write_diagnostics(scored: DataFrame, folder: str, group: str, order: str, threshold: float = 0.5,
                      head: int = 200) -> None:
    """Group statistics and the first false positives and negatives of a scored fold."""
    group_stats(scored, group).write.mode("overwrite").option("header", True).csv(f"{folder}/group_stats")
    errors = error_rows(scored, threshold)
    for kind in ("FP", "FN"):
        errors.where(F.col("error_kind") == kind).orderBy(order).limit(head).write.mode("overwrite").option(
            "header", True).csv(f"{folder}/{kind}_head")


def score_file(spark: SparkSession, path: str, scorer, output: str | None = None,
               columns: Sequence[str] | None = None) -> str:
    """Score a CSV file into ``<name>_predictions``."""
    target = output or f"{path.removesuffix('.csv')}_predictions"
    scored = scorer(read_csv(spark, path))
    (scored.select(*columns) if columns else scored).write.mode("overwrite").option("header", True).csv(target)
    return target
