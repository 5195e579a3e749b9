"""Writers for facts, features, results and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Overwrite a parquet table. With `partition_by`, rows are gathered by those columns into parts of
    the size adaptive execution aims at, so a large folder gets as many writers as it needs."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Replace a catalog table with the fact less its date."""
    writer = df.drop("date").write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_bucketed(
    df: DataFrame, table: str, path: str, keys: Sequence[str] = ("store_nbr", "family"), order: Sequence[str] = ("date",), buckets: int = 64
) -> None:
    """Replace a catalog table that is cut by year and, within, bucketed by `keys` and sorted: windows and
    joins over the keys read it without an exchange. The rows are dealt by key first, so that each bucket of
    a year is one file. `buckets` is for the table at full size: a bucket of a year should be some 100 MB."""
    rows = df.withColumn("year", F.year("date")).repartition(buckets, *keys)
    writer = rows.write.mode("overwrite").partitionBy("year").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", path).saveAsTable(table)


def overwrite_years(df: DataFrame, table: str, keys: Sequence[str] = ("store_nbr", "family")) -> None:
    """Replace, in a table of write_bucketed, the years that the rows of `df` have; files of other years are
    left alone. NULL dates have a year of their own."""
    spark = df.sparkSession
    held = spark.table(table)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows = df.withColumn("year", F.year("date")).repartition(buckets, *keys)
        rows.select(*held.columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_results(results: Mapping[str, DataFrame], folder: str) -> None:
    """The three inventory tables and the financial document of one optimisation."""
    write_parquet(results["safety_stock"], f"{folder}/safety_stock.parquet")
    write_parquet(results["inventory"], f"{folder}/inventory_recommendations.parquet")
    write_parquet(results["risk"], f"{folder}/stockout_risk.parquet")
    results["document"].write.mode("overwrite").json(f"{folder}/financial_impact.json")
