"""Feature groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from shelfcast.operators import day_frames as df
from shelfcast.operators import features as f
from shelfcast.plans.features import build_features
from shelfcast.sources import sinks
from shelfcast.sources.storage import new_path, stage

KEYS = ["date", "store_nbr", "family"]

VIEWS["oil_features"] = ("""
WITH d AS (SELECT DISTINCT date, oil_price FROM fact),
q AS (SELECT quantile_cont(oil_price, 0.33) AS q33, quantile_cont(oil_price, 0.66) AS q66 FROM d),
r AS (SELECT date, oil_price,
        LAG(oil_price, 7) OVER (ORDER BY date) AS oil_price_lag_7,
        AVG(oil_price) OVER (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS oil_price_ma_14,
        LEAST(GREATEST(COALESCE(oil_price / LAG(oil_price, 7) OVER (ORDER BY date) - 1, 0), -0.5), 0.5) AS oil_price_change_7,
        COALESCE(STDDEV_SAMP(oil_price) OVER (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS oil_price_volatility_14,
        CAST(CASE WHEN oil_price <= q33 THEN 0 WHEN oil_price <= q66 THEN 1 ELSE 2 END AS INT) AS oil_price_level
      FROM d CROSS JOIN q)
SELECT date, COALESCE(oil_price_lag_7, first_value(oil_price_lag_7 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS oil_price_lag_7,
       oil_price_ma_14, oil_price_change_7, oil_price_volatility_14, oil_price_level
FROM r""", ("fact",))
VIEWS["holiday_features"] = ("""
WITH d AS (SELECT DISTINCT date, is_holiday FROM fact),
a AS (SELECT d.date,
        CAST(LEAST(COALESCE((SELECT MIN(date_diff('day', h.date, d.date)) FROM d h WHERE h.is_holiday = 1 AND h.date <= d.date), 999), 60) AS INT) AS days_since_holiday,
        CAST(LEAST(COALESCE((SELECT MIN(date_diff('day', d.date, h.date)) FROM d h WHERE h.is_holiday = 1 AND h.date > d.date), 999), 60) AS INT) AS days_to_holiday
      FROM d)
SELECT *, 1.0::DOUBLE / (1 + LEAST(days_since_holiday, days_to_holiday)) AS holiday_proximity,
       CAST(days_to_holiday = 1 AS INT) AS is_holiday_eve, CAST(days_since_holiday = 1 AS INT) AS is_post_holiday,
       CAST(days_since_holiday <= 3 OR days_to_holiday <= 3 AS INT) AS is_holiday_week
FROM a""", ("fact",))
VIEWS["promo_features"] = ("""
SELECT date, store_nbr, family, CAST(onpromotion > 0 AS INT) AS has_promotion, ln(1 + onpromotion::DOUBLE) AS log_onpromotion,
       CAST(SUM(onpromotion) OVER (PARTITION BY date, store_nbr) AS DOUBLE) AS store_total_promotions,
       LEAST(GREATEST(COALESCE(onpromotion / NULLIF(AVG(onpromotion) OVER (PARTITION BY store_nbr), 0), 0), 0), 10) AS promo_vs_store_avg
FROM fact""", ("fact",))
VIEWS["txn_features"] = ("""
SELECT date, store_nbr, family, ln(1 + transactions::DOUBLE) AS log_transactions,
       LEAST(GREATEST(COALESCE(transactions / NULLIF(AVG(transactions) OVER (PARTITION BY store_nbr), 0), 1.0), 0), 5) AS txn_vs_store_avg
FROM fact""", ("fact",))
VIEWS["lag_features"] = ("""
SELECT date, store_nbr, family, LAG(sales, 7) OVER w AS sales_lag_7, LAG(sales, 14) OVER w AS sales_lag_14, LAG(sales, 28) OVER w AS sales_lag_28,
       CASE WHEN row_number() OVER w > 7 THEN AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS sales_rolling_mean_7,
       CASE WHEN row_number() OVER w > 28 THEN AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) END AS sales_rolling_mean_28
FROM clean WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date)""", ("clean",))
VIEWS["store_codes"] = ("""
SELECT store_nbr, CAST(dense_rank() OVER (ORDER BY city) - 1 AS INT) AS city_encoded,
       CAST(dense_rank() OVER (ORDER BY state) - 1 AS INT) AS state_encoded, CAST(dense_rank() OVER (ORDER BY store_type) - 1 AS INT) AS store_type_encoded
FROM stores WHERE store_nbr IN (SELECT store_nbr FROM sales)""", ("stores", "sales"))
VIEWS["time_features"] = ("""
SELECT date, store_nbr, family, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
       CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(day(date) IN (15, 30, 31) AS INT) AS is_payday
FROM clean""", ("clean",))
VIEWS["features"] = ("""
SELECT date, store_nbr, family, sales, onpromotion, is_zero_sales, city, state, store_type, cluster, oil_price,
       COALESCE(holiday_type, 'None') AS holiday_type, COALESCE(locale, 'None') AS locale, is_holiday, transactions,
       t.* EXCLUDE (date, store_nbr, family), s.* EXCLUDE (store_nbr), o.* EXCLUDE (date), h.* EXCLUDE (date),
       p.* EXCLUDE (date, store_nbr, family), x.* EXCLUDE (date, store_nbr, family),
       COALESCE(sales_lag_7, 0) AS sales_lag_7, COALESCE(sales_lag_14, 0) AS sales_lag_14, COALESCE(sales_lag_28, 0) AS sales_lag_28,
       COALESCE(sales_rolling_mean_7, 0) AS sales_rolling_mean_7, COALESCE(sales_rolling_mean_28, 0) AS sales_rolling_mean_28
FROM fact JOIN time_features t USING (date, store_nbr, family) JOIN store_codes s USING (store_nbr)
JOIN oil_features o USING (date) JOIN holiday_features h USING (date)
JOIN promo_features p USING (date, store_nbr, family) JOIN txn_features x USING (date, store_nbr, family)
JOIN lag_features l USING (date, store_nbr, family)""",
    ("fact", "time_features", "store_codes", "oil_features", "holiday_features", "promo_features", "txn_features", "lag_features"))

OIL_ROUNDS = {"oil_price_lag_7": 6, "oil_price_ma_14": 6, "oil_price_change_7": 6, "oil_price_volatility_14": 5}
HOLIDAY_ROUNDS = {"holiday_proximity": 6}
PROMO_ROUNDS = {"log_onpromotion": 6, "promo_vs_store_avg": 6}
TXN_ROUNDS = {"log_transactions": 6, "txn_vs_store_avg": 6}
LAG_ROUNDS = {"sales_rolling_mean_7": 6, "sales_rolling_mean_28": 6}


def _by_date(name, columns, rounds):
    def wrap(key, picked):
        sql = f"SELECT date, {', '.join(picked)} FROM {name}"
        return check(key, sql, {k: v for k, v in rounds.items() if k in picked}, (name,))
    return wrap


@check("scl1_day_of_week", "SELECT date, store_nbr, family, day_of_week FROM time_features", views=("time_features",))
def _(t: Tables):
    return f.add_time_features(t.sales).select(*KEYS, "day_of_week")


@check("scl2_month_year", "SELECT date, store_nbr, family, month, year FROM time_features", views=("time_features",))
def _(t: Tables):
    return f.add_time_features(t.sales).select(*KEYS, "month", "year")


@check("scl3_is_weekend", "SELECT date, store_nbr, family, is_weekend FROM time_features", views=("time_features",))
def _(t: Tables):
    return f.add_time_features(t.sales).select(*KEYS, "is_weekend")


@check("scl4_is_payday", "SELECT date, store_nbr, family, is_payday FROM time_features", views=("time_features",))
def _(t: Tables):
    return f.add_time_features(t.sales).select(*KEYS, "is_payday")


@check("dom2_time_features", "SELECT * FROM time_features", views=("time_features",))
def _(t: Tables):
    return f.add_time_features(t.sales.select(*KEYS))


@check("scl5_label_encode", "SELECT c.date, c.store_nbr, c.family, city_encoded, state_encoded, store_type_encoded FROM clean c JOIN store_codes USING (store_nbr)", views=("clean", "store_codes"))
def _(t: Tables):
    df = t.sales.select(*KEYS).join(t.stores.drop("cluster"), "store_nbr", "left")
    return f.add_store_features(df).drop("city", "state", "store_type")


@check("scl6_oil_price_level", "SELECT date, oil_price_level FROM oil_features", views=("oil_features",))
def _(t: Tables):
    return f.oil_features(t.fact).select("date", "oil_price_level")


_oil = _by_date("oil_features", f.OIL_FEATURES, OIL_ROUNDS)
_holiday = _by_date("holiday_features", f.HOLIDAY_FEATURES, HOLIDAY_ROUNDS)


def _register_date_features():
    for key, column in (
        ("win3_oil_lag", "oil_price_lag_7"), ("win4_oil_mean", "oil_price_ma_14"),
        ("win5_oil_change", "oil_price_change_7"), ("win6_oil_volatility", "oil_price_volatility_14"),
    ):
        _oil(key, [column])(lambda t, c=column: f.oil_features(t.fact).select("date", c))
    for key, columns in (
        ("jn7_last_holiday", ["days_since_holiday"]), ("jn8_next_holiday", ["days_to_holiday"]),
        ("win8_holiday_distance", ["days_since_holiday", "days_to_holiday"]),
        ("scl7_holiday_proximity", ["holiday_proximity"]),
        ("scl8_holiday_flags", ["is_holiday_eve", "is_post_holiday", "is_holiday_week"]),
        ("udf1_holiday_distance_native", f.HOLIDAY_FEATURES),
    ):
        _holiday(key, columns)(lambda t, c=columns: f.holiday_features(t.fact).select("date", *c))


_register_date_features()


@check("jn5_oil_join_back", "SELECT c.date, c.store_nbr, c.family, o.* EXCLUDE (date) FROM clean c JOIN oil_features o USING (date)", OIL_ROUNDS, ("clean", "oil_features"))
def _(t: Tables):
    return t.fact.select(*KEYS).join(F.broadcast(f.oil_features(t.fact)), "date", "left")


@check("jn6_holiday_join_back", "SELECT c.date, c.store_nbr, c.family, h.* EXCLUDE (date) FROM clean c JOIN holiday_features h USING (date)", HOLIDAY_ROUNDS, ("clean", "holiday_features"))
def _(t: Tables):
    return t.fact.select(*KEYS).join(F.broadcast(f.holiday_features(t.fact)), "date", "left")


@check("win10_store_totals_and_means", """
SELECT date, store_nbr, family, store_total_promotions, promo_vs_store_avg, txn_vs_store_avg
FROM promo_features JOIN txn_features USING (date, store_nbr, family)""", {"promo_vs_store_avg": 6, "txn_vs_store_avg": 6}, ("promo_features", "txn_features"))
def _(t: Tables):
    df = t.fact.select(*KEYS, "onpromotion", "transactions")
    return f.add_external_features(df).select(*KEYS, "store_total_promotions", "promo_vs_store_avg", "txn_vs_store_avg")


@check("scl9_promotion_flags", "SELECT date, store_nbr, family, has_promotion, log_onpromotion FROM promo_features", {"log_onpromotion": 6}, ("promo_features",))
def _(t: Tables):
    return f.add_promotion_features(t.sales).select(*KEYS, "has_promotion", "log_onpromotion")


@check("scl10_promo_vs_store", "SELECT date, store_nbr, family, promo_vs_store_avg FROM promo_features", {"promo_vs_store_avg": 6}, ("promo_features",))
def _(t: Tables):
    return f.add_promotion_features(t.sales).select(*KEYS, "promo_vs_store_avg")


@check("scl11_transaction_ratio", "SELECT * FROM txn_features", TXN_ROUNDS, ("txn_features",))
def _(t: Tables):
    return f.add_transaction_features(t.fact.select(*KEYS, "transactions")).drop("transactions")


@check("win1_sales_lags", "SELECT date, store_nbr, family, sales_lag_7, sales_lag_14, sales_lag_28 FROM lag_features", views=("lag_features",))
def _(t: Tables):
    from shelfcast.operators.etl import clean_sales
    return f.add_lag_features(clean_sales(t.sales), windows=()).select(*KEYS, "sales_lag_7", "sales_lag_14", "sales_lag_28")


@check("win2_rolling_mean", "SELECT date, store_nbr, family, sales_rolling_mean_7, sales_rolling_mean_28 FROM lag_features", LAG_ROUNDS, ("lag_features",))
def _(t: Tables):
    from shelfcast.operators.etl import clean_sales
    return f.add_lag_features(clean_sales(t.sales), lags=()).select(*KEYS, "sales_rolling_mean_7", "sales_rolling_mean_28")


@check("win1_day_lags", "SELECT c.date, c.store_nbr, c.family, " + ", ".join(f"l{k}.sales AS sales_day_lag_{k}" for k in (7, 14, 28)) + " FROM clean c " + " ".join(
    f"LEFT JOIN clean l{k} ON l{k}.store_nbr = c.store_nbr AND l{k}.family = c.family AND l{k}.date = c.date - {k}" for k in (7, 14, 28)), views=("clean",))
def _(t: Tables):
    from shelfcast.operators.etl import clean_sales
    return df.add_day_lags(clean_sales(t.sales), windows=()).select(*KEYS, "sales_day_lag_7", "sales_day_lag_14", "sales_day_lag_28")


@check("win2_day_means", "SELECT date, store_nbr, family, " + ", ".join(
    f"AVG(sales) OVER (PARTITION BY store_nbr, family ORDER BY date RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS sales_day_mean_{k}" for k in (7, 28)) + " FROM clean",
    {"sales_day_mean_7": 6, "sales_day_mean_28": 6}, ("clean",))
def _(t: Tables):
    from shelfcast.operators.etl import clean_sales
    return df.add_day_lags(clean_sales(t.sales), lags=()).select(*KEYS, "sales_day_mean_7", "sales_day_mean_28")


def _past(column: str) -> str:
    before = "(PARTITION BY store_nbr ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""p AS (SELECT store_nbr, date, SUM(s) OVER w / SUM(n) OVER w AS m
  FROM (SELECT store_nbr, date, SUM({column}) AS s, COUNT({column}) AS n FROM fact GROUP BY 1, 2) d WINDOW w AS {before})"""


@check("scl10_promo_vs_past", f"""
WITH {_past("onpromotion")}
SELECT date, store_nbr, family, LEAST(GREATEST(COALESCE(CASE WHEN m <> 0 THEN onpromotion / m END, 0), 0), 10) AS promo_vs_store_past
FROM fact JOIN p USING (store_nbr, date)""", {"promo_vs_store_past": 6}, ("fact",))
def _(t: Tables):
    return df.add_ratios_to_the_past(t.sales).select(*KEYS, "promo_vs_store_past")


@check("scl11_transactions_vs_past", f"""
WITH {_past("transactions")}
SELECT date, store_nbr, family, LEAST(GREATEST(COALESCE(CASE WHEN m <> 0 THEN transactions / m END, 1), 0), 5) AS txn_vs_store_past
FROM fact JOIN p USING (store_nbr, date)""", {"txn_vs_store_past": 6}, ("fact",))
def _(t: Tables):
    return df.add_ratios_to_the_past(t.fact.select(*KEYS, "transactions")).select(*KEYS, "txn_vs_store_past")


@check("snk3_bucketed_lags", "SELECT date, store_nbr, family, sales_lag_7, sales_lag_14, sales_lag_28 FROM lag_features", views=("lag_features",))
def _(t: Tables):
    """Row lags over the fact as it is stored for this: bucketed by series, one year written again."""
    path = new_path(t.spark, "bucketed_fact")
    name = "fact_by_series_" + path.split("/")[-2]
    fact = stage(t.fact, "fact")
    sinks.write_bucketed(fact, name, path, buckets=8)
    sinks.overwrite_years(fact.where(F.year("date") == 1995), name)
    return f.add_lag_features(t.spark.table(name), windows=()).select(*KEYS, "sales_lag_7", "sales_lag_14", "sales_lag_28")


@check("lim1_series_order", "SELECT date, store_nbr, family, CAST(row_number() OVER (PARTITION BY store_nbr, family ORDER BY date) AS INT) AS series_row FROM clean", views=("clean",))
def _(t: Tables):
    w = f.Window.partitionBy("store_nbr", "family").orderBy("date")
    return t.sales.select(*KEYS, F.row_number().over(w).alias("series_row"))


@check("dom3_external_features", """
SELECT date, store_nbr, family, o.* EXCLUDE (date), h.* EXCLUDE (date), p.* EXCLUDE (date, store_nbr, family), x.* EXCLUDE (date, store_nbr, family)
FROM fact JOIN oil_features o USING (date) JOIN holiday_features h USING (date)
JOIN promo_features p USING (date, store_nbr, family) JOIN txn_features x USING (date, store_nbr, family)
""", {**OIL_ROUNDS, **HOLIDAY_ROUNDS, **PROMO_ROUNDS, **TXN_ROUNDS}, ("oil_features", "holiday_features", "promo_features", "txn_features"))
def _(t: Tables):
    df = stage(t.fact.select(*KEYS, "oil_price", "is_holiday", "onpromotion", "transactions"), "sales_clean")
    return f.add_external_features(df).drop("oil_price", "is_holiday", "onpromotion", "transactions")


@check("prj7_smart_fill", """
SELECT c.date, c.store_nbr, c.family, COALESCE(f.holiday_type, 'None') AS holiday_type, COALESCE(l.sales_lag_7, 0) AS sales_lag_7
FROM clean c JOIN fact f USING (date, store_nbr, family) JOIN lag_features l USING (date, store_nbr, family)""", views=("fact", "lag_features"))
def _(t: Tables):
    df = f.add_lag_features(t.fact.select(*KEYS, "sales", "holiday_type"), lags=[7], windows=())
    return f.smart_fill(df).drop("sales")


ALL_ROUNDS = {"oil_price": 6, **OIL_ROUNDS, **HOLIDAY_ROUNDS, **PROMO_ROUNDS, **TXN_ROUNDS, **LAG_ROUNDS}


@check("dom4_features", "SELECT * FROM features", ALL_ROUNDS, ("features",))
def _(t: Tables):
    return build_features(stage(t.fact, "sales_clean"))


@check("snk3_features_parquet", "SELECT * FROM features", ALL_ROUNDS, ("features",))
def _(t: Tables):
    built = build_features(stage(t.fact, "sales_clean"))
    return t.spark.read.parquet(sinks.write_parquet(built, new_path(t.spark, "features_engineered")))
