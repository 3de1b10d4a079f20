"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it outlives any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else; texts of ASCII only take the faster built-in way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def joined_names(array: str) -> str:
    """SQL text: strings of an array sorted and comma-joined."""
    return f"array_join(array_sort({array}), ',')"


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let the Python workers import this package: sent once per application through Spark."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in [top / "__init__.py", *sorted((top / "llm").glob("*.py")), top / "session.py"]:
            z.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
