"""Reads of raw files that set bad rows aside instead of ending the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources import schemas

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Checked:
    """Typed rows, quarantined rows (record, file, reasons) and their numbers, which add up to `total`."""

    good: DataFrame
    bad: DataFrame
    total: int
    n_good: int
    n_bad: int


def read_checked(spark: SparkSession, path: str, schema: str, folder: str) -> Checked:
    """Read a CSV file with a header against a schema; store good rows in `{folder}/good` and bad ones in
    `{folder}/quarantine`.

    A row is bad if it has more or fewer cells than the header, or a cell that is not empty and does not
    read as its type; the reasons name each. Columns that the file does not have are left out, as are those
    beyond the schema. The numbers are observed while the rows are written; the file is read twice.
    """
    header = spark.read.option("header", True).csv(path).columns
    cells = ", ".join(f"`{c}` string" for c in header)
    # all cells are parsed even where few are asked for, or rows of a wrong length would pass
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT)
    rows = raw.schema(f"{cells}, {CORRUPT} string").csv(path).withColumn("_file", F.input_file_name())
    fields = [f.strip().split(" ") for f in schema.split(",")]
    fields = [(n, t) for n, t in fields if n in header]
    typed = {n: F.col(n).try_cast(t) for n, t in fields}
    reasons = [F.when(F.col(CORRUPT).isNotNull(), "number of cells")]
    reasons += [F.when(F.col(n).isNotNull() & typed[n].isNull(), f"{n} is no {t}") for n, t in fields]
    marked = rows.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    seen, good, bad = Observation(), Observation(), Observation()
    fine = marked.observe(seen, F.count(F.lit(1)).alias("rows")).where(F.size("reasons") == 0)
    fine.select(*[c.alias(n) for n, c in typed.items()]).observe(good, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/good")
    record = F.coalesce(F.col(CORRUPT), F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in header]), ","))
    aside = marked.where(F.size("reasons") > 0).select(record.alias("record"), F.col("_file").alias("file"), "reasons")
    aside.observe(bad, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/quarantine")
    total, n_good, n_bad = (o.get["rows"] for o in (seen, good, bad))
    if total != n_good + n_bad:
        raise RuntimeError(f"{path}: {n_good} good and {n_bad} bad rows of {total}; the file has changed between the reads")
    return Checked(spark.read.parquet(f"{folder}/good"), spark.read.parquet(f"{folder}/quarantine"), total, n_good, n_bad)


def read_raw_checked(spark: SparkSession, source: str, folder: str) -> dict[str, Checked]:
    """The five raw tables, each with its quarantine below `folder`."""
    return {name: read_checked(spark, f"{source}/{schemas.RAW_FILES[name]}", schema, f"{folder}/{name}") for name, schema in schemas.RAW.items()}
