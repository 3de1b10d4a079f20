"""Session settings and the few places where lineage or scratch files are needed."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "wishgrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Locally rows are few but costly: keep all cores busy instead of merging small partitions.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # Costly per-row work gets all cores also where the input is small.
        .config("spark.sql.files.minPartitionNum", str(partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; the cluster or ``build_session`` names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a written parquet table in the shared folder and read it back.

    Survives the loss of any executor, unlike blocks kept on executors only.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values (rule packs, dimensions): its size is known when it is written down."""
    return F.broadcast(spark.createDataFrame(rows, schema))
