"""Session defaults and the shared scratch folder every materialising operator uses."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BROADCAST_ROW_LIMIT = 200_000


def build_session(app_name: str = "baitlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; cluster sizing stays with the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="baitlens-")
    spark.conf.set(CHECKPOINT_KEY, made)
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call returns a new one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step", compression: str | None = None, by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss.

    With ``by``, each value of this column has files of its own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path, partitionBy=by, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more, and the shuffle files of dropped ones."""
    jvm = spark.sparkContext._jvm
    for folder in {file.rpartition("/")[0] for frame in frames for file in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps partition boundaries and the row order inside them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows``; otherwise leave the join to AQE."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose scan has fewer tasks than the cluster has slots is spread first: much work on few bytes."""
    table = read_table(spark, folder, name)
    slots = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= slots else table.repartition(slots)
