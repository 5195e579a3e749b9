"""Where intermediate and output tables of a job go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Only a local session may fall
    back to a temporary folder of its own machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="shelfcast-"))
    return _local_folder[0]


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/shelfcast/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str, kind: str = "tables") -> str:
    return f"{_application_folder(spark)}/{kind}/{uuid.uuid4().hex}/{name}"


def model_folder(spark: SparkSession) -> str:
    """Where trained models are kept for all applications."""
    return f"{shared_folder(spark)}/shelfcast/models"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back. It cuts the lineage, lives
    in the shared folder, so lost executors do not lose it, and gives Spark true sizes."""
    path = new_path(df.sparkSession, name, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_staged(spark: SparkSession) -> bool:
    """Delete what this application staged, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_application_folder(spark)}/staged")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
