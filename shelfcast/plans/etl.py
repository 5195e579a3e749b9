"""Raw CSV folder -> stored sales fact and feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.etl import build_sales_fact, narrow_types
from shelfcast.plans.features import build_features
from shelfcast.sources.readers import read_raw
from shelfcast.sources.sinks import write_parquet, write_table


def run_etl(spark: SparkSession, raw_folder: str, out_folder: str, table: str | None = None) -> DataFrame:
    """Read the raw tables, write the clean fact partitioned by year (and as a catalog table
    without its date, if a name is given) and return the stored fact."""
    fact = build_sales_fact(read_raw(spark, raw_folder)).withColumn("year", F.year("date"))
    path = write_parquet(narrow_types(fact), f"{out_folder}/sales_clean.parquet", ["year"])
    stored = spark.read.parquet(path)
    if table:
        write_table(stored, table)
    return stored.drop("year")


def run_features(fact: DataFrame, out_folder: str) -> DataFrame:
    """Write the feature table of a stored fact and return it as stored."""
    path = write_parquet(build_features(fact), f"{out_folder}/features_engineered.parquet")
    return fact.sparkSession.read.parquet(path)
