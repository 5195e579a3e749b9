"""The retail inputs derived from the order tables at hand.

Only the columns needed are read, and dimension joins carry no hint: Spark broadcasts a side
when its file size (or, at run time, its shuffled size) is small and splits skewed keys else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# month*100+day, ordinal, type, locale, transferred.
HOLIDAY_RULES = [
    (101, 1, "Holiday", "National", False),
    (501, 1, "Holiday", "National", False),
    (524, 1, "Holiday", "National", True),
    (810, 1, "Event", "Local", False),
    (1225, 1, "Holiday", "National", False),
    (1225, 2, "Additional", "Regional", False),
]


# Columns used of each order table. Stating them spares a job per table to look them up.
ORDER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_type string",
    "orders": "o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    ),
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(ORDER_TABLES[table]).parquet(f"{folder}/{table}.parquet")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    n, r = _read(spark, folder, "nation"), _read(spark, folder, "region")
    kind = F.element_at(
        F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("n_nationkey") % 5 + 1).cast("int")
    )
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("int").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        kind.alias("store_type"),
        (F.col("n_nationkey") % 17).cast("int").alias("cluster"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    lines, s, p = (_read(spark, folder, t) for t in ("lineitem", "supplier", "part"))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return (
        lines.join(s, lines.l_suppkey == s.s_suppkey)
        .join(p, lines.l_partkey == p.p_partkey)
        .groupBy(
            F.to_date("l_shipdate").alias("date"),
            F.col("s_nationkey").cast("int").alias("store_nbr"),
            F.col("p_type").alias("family"),
        )
        .agg(
            F.sum(F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("sales"),
            F.count_if(F.col("l_discount") >= 0.08).cast("int").alias("onpromotion"),
        )
    )


def oil(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg((F.min("o_totalprice") / 1000.0).alias("dcoilwtico"))
    )


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    dates = _read(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    rules = F.array(
        *[
            F.struct(
                F.lit(md).alias("md"),
                F.lit(ordinal).alias("ordinal"),
                F.lit(kind).alias("type"),
                F.lit(locale).alias("locale"),
                F.lit(moved).alias("transferred"),
            )
            for md, ordinal, kind, locale, moved in HOLIDAY_RULES
        ]
    )
    today = F.month("date") * 100 + F.dayofmonth("date")
    return dates.select("date", F.inline(F.filter(rules, lambda h: h["md"] == today))).drop("md")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    lines, s = _read(spark, folder, "lineitem"), _read(spark, folder, "supplier")
    return (
        lines.join(s, lines.l_suppkey == s.s_suppkey)
        .groupBy(F.to_date("l_shipdate").alias("date"), F.col("s_nationkey").cast("int").alias("store_nbr"))
        .agg(F.countDistinct("l_orderkey").cast("int").alias("transactions"))
    )


BUILDERS = {
    "train": sales,
    "stores": stores,
    "oil": oil,
    "holidays": holidays,
    "transactions": transactions,
}


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: build(spark, folder) for name, build in BUILDERS.items()}


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast fact with stand-in base forecasts. A series holds at most one row per day, so
    its window is bounded by the calendar."""
    fact = sales(spark, folder).select(
        "date", "store_nbr", "family", F.greatest("sales", F.lit(0.0)).alias("sales")
    )
    series = Window.partitionBy("store_nbr", "family").orderBy("date")
    month = Window.partitionBy("store_nbr", "family", F.month("date"))
    base = fact.select(
        "*",
        F.coalesce(F.avg("sales").over(series.rowsBetween(-7, -1)), F.lit(25.0)).alias("forecast_xgboost"),
        F.coalesce(F.lag("sales", 7).over(series), F.lit(25.0)).alias("forecast_rf"),
        F.avg("sales").over(month).alias("forecast_prophet"),
    )
    blended = (
        0.5 * F.col("forecast_xgboost") + 0.3 * F.col("forecast_rf") + 0.2 * F.col("forecast_prophet")
    )
    return base.select(
        "*",
        blended.alias("forecast_ensemble"),
        F.greatest(blended - 15.0, F.lit(0.0)).alias("forecast_lower"),
        (blended + 15.0).alias("forecast_upper"),
    )
