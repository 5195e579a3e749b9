"""Registration of queries with their comparison SQL, and the tables both sides start from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.etl import build_sales_fact
from shelfcast.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The retail inputs over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return adapter.raw_tables(self.spark, self.folder)

    @cached_property
    def sales(self) -> DataFrame:
        return adapter.sales(self.spark, self.folder)

    @cached_property
    def stores(self) -> DataFrame:
        return adapter.stores(self.spark, self.folder)

    @cached_property
    def oil(self) -> DataFrame:
        return adapter.oil(self.spark, self.folder)

    @cached_property
    def holidays(self) -> DataFrame:
        return adapter.holidays(self.spark, self.folder)

    @cached_property
    def transactions(self) -> DataFrame:
        return adapter.transactions(self.spark, self.folder)

    @cached_property
    def fact(self) -> DataFrame:
        return build_sales_fact(self.raw)

    @cached_property
    def forecasts(self) -> DataFrame:
        return adapter.forecasts(self.spark, self.folder)


def rounded(df: DataFrame, rounds: Mapping[str, int]) -> DataFrame:
    return df.select(
        *[F.round(c, rounds[c]).alias(c) if c in rounds else F.col(c) for c in df.columns]
    )


def check(
    key: str,
    sql: str | None = None,
    rounds: Mapping[str, int] | None = None,
    views: tuple[str, ...] = (),
) -> Callable:
    """Register a query under `key`. `rounds` gives the decimals of floating-point columns,
    applied to both sides; `views` names the derived views the SQL uses."""
    rounds = dict(rounds or {})

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), rounds)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql, rounds, views)
        return fn

    return wrap


def with_views(sql: str, rounds: Mapping[str, int], views: tuple[str, ...]) -> str:
    wanted: list[str] = []

    def need(name: str) -> None:
        text, deps = VIEWS[name]
        for d in deps:
            need(d)
        if name not in wanted:
            wanted.append(name)

    for v in views:
        need(v)
    ctes = [f"{name} AS (\n{VIEWS[name][0].strip()}\n)" for name in wanted]
    ctes.append(f"result AS (\n{sql.strip()}\n)")
    replaced = ", ".join(f"round({c}, {d}) AS {c}" for c, d in rounds.items())
    star = f"* REPLACE ({replaced})" if replaced else "*"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {star} FROM result"


# name -> (SQL, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "stores": (
        """
SELECT CAST(n.n_nationkey AS INT) AS store_nbr, n.n_name AS city, r.r_name AS state,
       CASE n.n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS store_type,
       CAST(n.n_nationkey % 17 AS INT) AS cluster
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
        (),
    ),
    "sales": (
        """
SELECT CAST(l.l_shipdate AS DATE) AS date, CAST(s.s_nationkey AS INT) AS store_nbr, p.p_type AS family,
       SUM(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -l.l_quantity ELSE l.l_quantity END) AS sales,
       CAST(SUM(CASE WHEN l.l_discount >= 0.08 THEN 1 ELSE 0 END) AS INT) AS onpromotion
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3""",
        (),
    ),
    "oil": (
        """
SELECT CAST(o_orderdate AS DATE) AS date, MIN(o_totalprice) / CAST(1000.0 AS DOUBLE) AS dcoilwtico
FROM orders
GROUP BY 1""",
        (),
    ),
    "holidays": (
        """
SELECT d.date, h.ordinal, h.type, h.locale, h.transferred
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) d
JOIN (VALUES (101, 1, 'Holiday', 'National', false), (501, 1, 'Holiday', 'National', false),
             (524, 1, 'Holiday', 'National', true),  (810, 1, 'Event', 'Local', false),
             (1225, 1, 'Holiday', 'National', false), (1225, 2, 'Additional', 'Regional', false))
     AS h(md, ordinal, type, locale, transferred)
  ON EXTRACT(month FROM d.date) * 100 + EXTRACT(day FROM d.date) = h.md""",
        (),
    ),
    "transactions": (
        """
SELECT CAST(l.l_shipdate AS DATE) AS date, CAST(s.s_nationkey AS INT) AS store_nbr,
       CAST(COUNT(DISTINCT l.l_orderkey) AS INT) AS transactions
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2""",
        (),
    ),
    "forecasts": (
        """
WITH f AS (SELECT date, store_nbr, family, CASE WHEN sales < 0 THEN CAST(0.0 AS DOUBLE) ELSE sales END AS sales FROM sales),
b AS (SELECT *,
  COALESCE(AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), CAST(25.0 AS DOUBLE)) AS forecast_xgboost,
  COALESCE(LAG(sales, 7) OVER (PARTITION BY store_nbr, family ORDER BY date), CAST(25.0 AS DOUBLE)) AS forecast_rf,
  AVG(sales) OVER (PARTITION BY store_nbr, family, EXTRACT(month FROM date)) AS forecast_prophet FROM f),
e AS (SELECT *, CAST(0.5 AS DOUBLE) * forecast_xgboost + CAST(0.3 AS DOUBLE) * forecast_rf + CAST(0.2 AS DOUBLE) * forecast_prophet AS forecast_ensemble FROM b)
SELECT date, store_nbr, family, sales, forecast_xgboost, forecast_rf, forecast_prophet, forecast_ensemble,
       GREATEST(forecast_ensemble - CAST(15.0 AS DOUBLE), CAST(0.0 AS DOUBLE)) AS forecast_lower, forecast_ensemble + CAST(15.0 AS DOUBLE) AS forecast_upper
FROM e""",
        ("sales",),
    ),
    "oil_daily": (
        """
SELECT date, COALESCE(
    last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS oil_price
FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM oil) s
LEFT JOIN oil USING (date)""",
        ("oil",),
    ),
    "oil_by_date": (
        """
SELECT date, COALESCE(
    last_value(oil_price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(oil_price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS oil_price
FROM (SELECT DISTINCT date FROM sales) d LEFT JOIN oil_daily USING (date)""",
        ("sales", "oil_daily"),
    ),
    "holiday_by_date": (
        """
SELECT date, type AS holiday_type, locale
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ordinal) AS rn FROM holidays WHERE transferred = false) h
WHERE rn = 1""",
        ("holidays",),
    ),
    "clean": (
        """
SELECT date, store_nbr, family, GREATEST(sales, 0.0) AS sales, onpromotion,
       CAST(CASE WHEN GREATEST(sales, 0.0) = 0 THEN 1 ELSE 0 END AS INT) AS is_zero_sales
FROM sales""",
        ("sales",),
    ),
    "fact": (
        """
SELECT c.*, s.city, s.state, s.store_type, s.cluster, o.oil_price, h.holiday_type, h.locale,
       CAST(CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS INT) AS is_holiday,
       COALESCE(t.transactions, 0) AS transactions
FROM clean c LEFT JOIN stores s USING (store_nbr) LEFT JOIN oil_by_date o USING (date)
LEFT JOIN holiday_by_date h USING (date) LEFT JOIN transactions t USING (date, store_nbr)""",
        ("clean", "stores", "oil_by_date", "holiday_by_date", "transactions"),
    ),
}
