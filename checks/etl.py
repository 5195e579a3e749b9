"""Sources, projections, joins and windows of the sales fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, check
from shelfcast.operators import etl
from shelfcast.operators.fill import densify_daily
from shelfcast.sources import adapter, quarantine, readers, sinks
from shelfcast.sources.storage import new_path

FACT_COLUMNS = """date, store_nbr, family, sales, onpromotion, is_zero_sales, city, state, store_type, cluster,
       oil_price, holiday_type, locale, is_holiday, transactions"""
OIL = {"oil_price": 6}


@check("src1_raw_tables", """
SELECT 'train' AS name, CAST(count(*) AS BIGINT) AS row_count, min(date) AS first_date, max(date) AS last_date, CAST(sum(sales) AS DOUBLE) AS total FROM sales
UNION ALL SELECT 'stores', count(*), NULL, NULL, sum(cluster) FROM stores
UNION ALL SELECT 'oil', count(*), min(date), max(date), round(sum(dcoilwtico), 4) FROM oil
UNION ALL SELECT 'holidays', count(*), min(date), max(date), sum(CASE WHEN transferred THEN 1 ELSE 0 END) FROM holidays
UNION ALL SELECT 'transactions', count(*), min(date), max(date), sum(transactions) FROM transactions
""", views=("sales", "stores", "oil", "holidays", "transactions"))
def _(t: Tables):
    """The five raw tables written as CSV with a header and read back with their types."""
    folder = new_path(t.spark, "raw")
    for name, file in readers.schemas.RAW_FILES.items():
        sinks.write_csv(t.raw[name], f"{folder}/{file}")
    raw = readers.read_raw(t.spark, folder)
    measure = {
        "train": F.sum("sales"),
        "stores": F.sum("cluster"),
        "oil": F.round(F.sum("dcoilwtico"), 4),
        "holidays": F.sum(F.col("transferred").cast("int")),
        "transactions": F.sum("transactions"),
    }
    parts = []
    for name, df in raw.items():
        dated = "date" in df.columns
        parts.append(
            df.agg(
                F.lit(name).alias("name"),
                F.count(F.lit(1)).alias("row_count"),
                (F.min("date") if dated else F.lit(None).cast("date")).alias("first_date"),
                (F.max("date") if dated else F.lit(None).cast("date")).alias("last_date"),
                measure[name].cast("double").alias("total"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@check("src2_read_forecasts", "SELECT date, store_nbr, family, forecast_ensemble FROM forecasts",
       {"forecast_ensemble": 6}, ("forecasts",))
def _(t: Tables):
    path = new_path(t.spark, "forecasts.parquet")
    sinks.write_parquet(t.forecasts.withColumn("date", F.col("date").cast("timestamp")), path)
    return readers.read_forecasts(t.spark, path).select("date", "store_nbr", "family", "forecast_ensemble")


@check("prj1_clip_sales", "SELECT date, store_nbr, family, sales FROM clean", views=("clean",))
def _(t: Tables):
    return etl.clean_sales(t.sales).select("date", "store_nbr", "family", "sales")


@check("prj2_zero_flag", "SELECT date, store_nbr, family, is_zero_sales FROM clean", views=("clean",))
def _(t: Tables):
    return etl.clean_sales(t.sales).select("date", "store_nbr", "family", "is_zero_sales")


@check("prj3_holiday_predicate", "SELECT date, ordinal, type, locale FROM holidays WHERE transferred = false", views=("holidays",))
def _(t: Tables):
    return t.holidays.where(~F.col("transferred")).drop("transferred")


@check("prj4_holiday_projection", "SELECT date, type AS holiday_type, locale FROM holidays", views=("holidays",))
def _(t: Tables):
    return t.holidays.select("date", F.col("type").alias("holiday_type"), "locale")


@check("prj5_null_defaults", "SELECT date, store_nbr, family, is_holiday, transactions FROM fact", views=("fact",))
def _(t: Tables):
    return t.fact.select("date", "store_nbr", "family", "is_holiday", "transactions")


@check("prj6_narrow_types", """
SELECT date, family, CAST(store_nbr AS TINYINT) AS store_nbr, CAST(onpromotion AS TINYINT) AS onpromotion,
       CAST(sales AS FLOAT) AS sales, CAST(transactions AS SMALLINT) AS transactions
FROM (SELECT date, family, store_nbr, onpromotion, sales, transactions + 1000 AS transactions FROM fact)
""", views=("fact",))
def _(t: Tables):
    wide = t.fact.select(
        "date", "family", F.col("store_nbr").cast("bigint").alias("store_nbr"),
        F.col("onpromotion").cast("bigint").alias("onpromotion"), "sales",
        (F.col("transactions") + 1000).cast("bigint").alias("transactions"),
    )
    return etl.narrow_types(wide)


@check("prj15_quality_row", """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN date IS NULL OR store_nbr IS NULL OR family IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys,
       CAST(sum(neg) AS BIGINT) AS negative_sales, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys
FROM (SELECT date, store_nbr, family, count(*) AS n, sum(CASE WHEN sales < 0 THEN 1 ELSE 0 END) AS neg FROM sales GROUP BY 1, 2, 3)
""", views=("sales",))
def _(t: Tables):
    return etl.quality_row(t.sales)


@check("src1_quarantine", """
WITH r AS (SELECT (store_nbr * 31 + CAST(epoch(date) / 86400 AS BIGINT)) % 97 AS k, sales FROM sales),
n AS (SELECT count(*) AS total, count(*) FILTER (k IN (3, 4, 5)) AS bad, count(*) FILTER (k = 3) AS bad_sales, count(*) FILTER (k = 4) AS bad_date,
             count(*) FILTER (k = 5) AS bad_cells, sum(sales) FILTER (k NOT IN (3, 4, 5)) AS good_sales FROM r)
SELECT total, total - bad AS n_good, bad AS n_bad, bad_sales, bad_date, bad_cells, good_sales FROM n""", views=("sales",))
def _(t: Tables):
    """The sales as CSV lines, some of them damaged: a word for a number, a day that is none, a cell too many."""
    folder = new_path(t.spark, "raw_with_faults")
    k = (F.col("store_nbr") * 31 + F.unix_date("date")) % 97
    cells = [
        F.when(k == 4, "1995-02-30").otherwise(F.col("date").cast("string")), F.col("store_nbr").cast("string"), F.col("family"),
        F.when(k == 3, "many").otherwise(F.col("sales").cast("string")), F.when(k == 5, F.concat(F.col("onpromotion").cast("string"), F.lit(",1"))).otherwise(F.col("onpromotion").cast("string")),
    ]
    lines = t.sales.select(F.array_join(F.array(*cells), ",").alias("line"))
    # every file begins with a header, as those of a CSV export do
    headed = lines.mapInPandas(lambda frames: _headed(frames), "line string")
    headed.write.text(f"{folder}/train.csv")
    checked = quarantine.read_checked(t.spark, f"{folder}/train.csv", readers.schemas.SALES, f"{folder}/checked")
    reason = {"bad_sales": "sales is no double", "bad_date": "date is no date", "bad_cells": "number of cells"}
    bad = checked.bad.agg(*[F.count_if(F.array_contains("reasons", r)).alias(c) for c, r in reason.items()])
    good = checked.good.agg(F.sum("sales").alias("good_sales"))
    counts = [F.lit(v).cast("long").alias(c) for c, v in (("total", checked.total), ("n_good", checked.n_good), ("n_bad", checked.n_bad))]
    return bad.select(*counts, *reason, good.scalar().alias("good_sales"))


def _headed(frames):
    import pandas as pd

    yield pd.DataFrame({"line": ["date,store_nbr,family,sales,onpromotion"]})
    yield from frames


@check("jn1_sales_stores", "SELECT c.date, c.store_nbr, c.family, s.city, s.state, s.store_type, s.cluster FROM clean c LEFT JOIN stores s USING (store_nbr)", views=("clean", "stores"))
def _(t: Tables):
    return t.sales.select("date", "store_nbr", "family").join(t.stores, "store_nbr", "left")


@check("jn2_sales_oil", "SELECT s.date, s.store_nbr, s.family, o.oil_price FROM sales s LEFT JOIN oil_daily o USING (date)", OIL, ("sales", "oil_daily"))
def _(t: Tables):
    daily = etl.daily_oil_price(t.oil)
    return t.sales.select("date", "store_nbr", "family").join(F.broadcast(daily), "date", "left")


@check("jn3_sales_holidays", "SELECT s.date, s.store_nbr, s.family, h.holiday_type, h.locale FROM sales s LEFT JOIN holiday_by_date h USING (date)", views=("sales", "holiday_by_date"))
def _(t: Tables):
    dim = etl.effective_holidays(t.holidays)
    return t.sales.select("date", "store_nbr", "family").join(F.broadcast(dim), "date", "left")


@check("jn4_sales_transactions", "SELECT s.date, s.store_nbr, s.family, CAST(t.transactions AS DOUBLE) AS transactions FROM sales s LEFT JOIN transactions t USING (date, store_nbr)", views=("sales", "transactions"))
def _(t: Tables):
    return t.sales.select("date", "store_nbr", "family").join(
        t.transactions.withColumn("transactions", F.col("transactions").cast("double")), ["date", "store_nbr"], "left"
    )


@check("set4_calendar_spine", "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM oil", views=("oil",))
def _(t: Tables):
    return densify_daily(t.oil).select("date")


@check("win7_fill_both_ways", "SELECT * FROM oil_by_date", OIL, ("oil_by_date",))
def _(t: Tables):
    return etl.oil_for_dates(t.sales.select("date").distinct(), t.oil)


@check("win13_first_per_date", "SELECT * FROM holiday_by_date", views=("holiday_by_date",))
def _(t: Tables):
    return etl.effective_holidays(t.holidays)


@check("dom1_sales_fact", f"SELECT {FACT_COLUMNS} FROM fact", OIL, ("fact",))
def _(t: Tables):
    return t.fact


@check("snk1_fact_parquet", f"SELECT {FACT_COLUMNS}, CAST(EXTRACT(year FROM date) AS INT) AS year FROM fact", OIL, ("fact",))
def _(t: Tables):
    path = sinks.write_parquet(
        t.fact.withColumn("year", F.year("date")), new_path(t.spark, "sales_clean"), ["year"]
    )
    return t.spark.read.parquet(path)


@check("snk2_fact_table", f"SELECT {FACT_COLUMNS.replace('date, ', '', 1)} FROM fact", OIL, ("fact",))
def _(t: Tables):
    path = new_path(t.spark, "sales_table")
    name = "sales_clean_" + path.split("/")[-2]
    sinks.write_table(t.fact, name, path)
    return t.spark.table(name)
