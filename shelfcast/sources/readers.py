"""Typed reads of the raw inputs and of the tables written by earlier steps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources import schemas


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five raw CSV tables, typed by name; file columns beyond the schema are left out."""
    return {
        name: _typed_csv(spark, f"{folder}/{schemas.RAW_FILES[name]}", schema)
        for name, schema in schemas.RAW.items()
    }


def _typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    present = set(raw.columns)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in fields if n in present])


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if dict(df.dtypes)["date"] == "date":
        return df  # left uncast, so that date filters reach the files
    return df.withColumn("date", F.to_date("date"))


def read_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or no rows of the given schema where the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def read_financial_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FINANCIAL).option("multiLine", True).json(path)
