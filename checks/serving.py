"""Anomalies and the reads behind requests and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from checks.inventory import COMP, INV, SAVE, _comparison
from shelfcast.operators import anomaly as an
from shelfcast.operators import finance as fin
from shelfcast.operators import serving as sv
from shelfcast.operators.reorder import reorder_plan
from shelfcast.operators.safety_stock import safety_stock
from shelfcast.plans.optimize import optimize_inventory
from shelfcast.sources import sinks
from shelfcast.sources.storage import new_path, stage

KEYS = ["date", "store_nbr", "family"]

VIEWS["anomalies"] = ("""
WITH s AS (SELECT AVG(sales - forecast_ensemble) AS m, STDDEV_SAMP(sales - forecast_ensemble) AS sd FROM forecasts),
d AS (SELECT store_nbr, family, date, sales, forecast_ensemble, sales - forecast_ensemble AS deviation,
             CASE WHEN forecast_ensemble > 0 THEN (sales - forecast_ensemble) / forecast_ensemble ELSE 0 END AS pct_deviation,
             CASE WHEN sd > 0 THEN (sales - forecast_ensemble - m) / sd ELSE 0 END AS z FROM forecasts, s)
SELECT * EXCLUDE (z), LEAST(GREATEST(ABS(pct_deviation) * 100 + ABS(z) * 10, 0), 100) AS severity,
       CASE WHEN deviation > 0 THEN 'Spike' WHEN deviation < 0 THEN 'Drop' ELSE 'Normal' END AS anomaly_type
FROM d WHERE ABS(pct_deviation) > 0.5 OR ABS(z) > 3""", ("forecasts",))
ANOMALY = {"forecast_ensemble": 6, "deviation": 6, "pct_deviation": 6, "severity": 6}


def _anomalies(t: Tables):
    return an.detect_anomalies(t.forecasts, segment_cols=["store_nbr", "family"])


@check("dom12_anomalies", "SELECT * FROM anomalies", ANOMALY, ("anomalies",))
def _(t: Tables):
    return _anomalies(t)


_LEVEL = "CASE WHEN n2 >= 30 THEN {0}2 WHEN n1 >= 30 THEN {0}1 ELSE {0}0 END"


@check("dom12_segment_anomalies", f"""
WITH d AS (SELECT store_nbr, family, date, sales, forecast_ensemble, sales - forecast_ensemble AS deviation,
                  CASE WHEN forecast_ensemble > 0 THEN (sales - forecast_ensemble) / forecast_ensemble ELSE 0 END AS pct_deviation FROM forecasts),
s AS (SELECT *, count(deviation) OVER a AS n2, avg(deviation) OVER a AS m2, stddev_samp(deviation) OVER a AS d2,
             count(deviation) OVER b AS n1, avg(deviation) OVER b AS m1, stddev_samp(deviation) OVER b AS d1,
             count(deviation) OVER () AS n0, avg(deviation) OVER () AS m0, stddev_samp(deviation) OVER () AS d0
      FROM d WINDOW a AS (PARTITION BY store_nbr, family), b AS (PARTITION BY store_nbr)),
z AS (SELECT *, CASE WHEN {_LEVEL.format("d")} > 0 THEN (deviation - {_LEVEL.format("m")}) / {_LEVEL.format("d")} ELSE 0 END AS z,
             CASE WHEN n2 >= 30 THEN 'store_nbr, family' WHEN n1 >= 30 THEN 'store_nbr' ELSE 'all' END AS baseline, {_LEVEL.format("n")} AS baseline_n FROM s)
SELECT store_nbr, family, date, baseline, baseline_n,
       LEAST(GREATEST(ABS(pct_deviation) * 100 + ABS(z) * 10, 0), 100) AS severity,
       CASE WHEN deviation > 0 THEN 'Spike' WHEN deviation < 0 THEN 'Drop' ELSE 'Normal' END AS anomaly_type
FROM z WHERE ABS(pct_deviation) > 0.5 OR ABS(z) > 3""", {"severity": 6}, ("forecasts",))
def _(t: Tables):
    found = an.detect_anomalies(t.forecasts, segment_cols=["store_nbr", "family"], levels=[["store_nbr", "family"], ["store_nbr"]], min_samples=30)
    return found.select("store_nbr", "family", "date", "baseline", "baseline_n", "severity", "anomaly_type")


@check("agg15_anomaly_summary", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE anomaly_type = 'Spike') AS spikes, COUNT(*) FILTER (WHERE anomaly_type = 'Drop') AS drops,
       COALESCE(AVG(severity), 0) AS avg_severity, COALESCE(MAX(severity), 0) AS max_severity FROM anomalies""", {"avg_severity": 6, "max_severity": 6}, ("anomalies",))
def _(t: Tables):
    return an.anomaly_summary(_anomalies(t))


@check("lim4_top_anomalies", """
SELECT store_nbr, family, date, sales, anomaly_type, severity FROM anomalies ORDER BY severity DESC, date, store_nbr, family LIMIT 10""", {"severity": 6}, ("anomalies",))
def _(t: Tables):
    return an.top_anomalies(_anomalies(t), 10, KEYS).select("store_nbr", "family", "date", "sales", "anomaly_type", "severity")


@check("scl21_anomaly_text", """
SELECT date, store_nbr, family, CASE WHEN forecast_ensemble > 0 THEN (sales - forecast_ensemble) / forecast_ensemble * 100 ELSE 0 END AS deviation_pct,
       CASE WHEN sales > forecast_ensemble THEN 'higher' ELSE 'lower' END AS direction FROM anomalies""", {"deviation_pct": 5}, ("anomalies",))
def _(t: Tables):
    return an.describe(_anomalies(t)).select(*KEYS, "deviation_pct", "direction")


@check("prj8_apply_filters", """
SELECT date, store_nbr, family, sales FROM forecasts WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND store_nbr IN (1, 2, 3, 7) AND family IN ('PROMO', 'SMALL', 'LARGE')""", views=("forecasts",))
def _(t: Tables):
    chosen = sv.apply_filters(t.forecasts, dt.date(1996, 1, 1), dt.date(1998, 12, 31), [1, 2, 3, 7], ["PROMO", "SMALL", "LARGE"])
    return chosen.select(*KEYS, "sales")


@check("prj9_store_category_predicate", "SELECT date, store_nbr, family, forecast_ensemble FROM forecasts WHERE store_nbr IN (1, 2, 3) AND family IN ('PROMO')", {"forecast_ensemble": 6}, ("forecasts",))
def _(t: Tables):
    return sv.apply_filters(t.forecasts, stores=[1, 2, 3], families=["PROMO"]).select(*KEYS, "forecast_ensemble")


@check("prj10_forecast_column", "SELECT date, store_nbr, family, forecast_rf AS chosen FROM forecasts", {"chosen": 6}, ("forecasts",))
def _(t: Tables):
    return t.forecasts.select(*KEYS, F.col(sv.forecast_column(t.forecasts, "random_forest")).alias("chosen"))


@check("prj11_segment_predicate", "SELECT * FROM inv WHERE segment IN (1, 2, 3)", INV, ("inv",))
def _(t: Tables):
    return sv.restrict_segments(reorder_plan(safety_stock(t.forecasts)), [1, 2, 3])


RESPONSE = """
SELECT strftime(date, '%Y-%m-%d') AS date, store_nbr, round(forecast_ensemble + 1e-9::DOUBLE, 2) AS predicted_sales, round(sales, 2) AS actual_sales, family AS category
FROM (SELECT * FROM forecasts {where}) f WHERE date < (SELECT min(date) FROM forecasts {where}) + {days}"""


@check("prj12_response_rows", RESPONSE.format(where="", days=16), views=("forecasts",))
def _(t: Tables):
    nudged = t.forecasts.withColumn("forecast_ensemble", F.col("forecast_ensemble") + 1e-9)
    return sv.response_rows(nudged, "forecast_ensemble", 16)


@check("lim6_response_cap", RESPONSE.format(where="", days=90) + " ORDER BY 1, 2, 5 LIMIT 1000", views=("forecasts",))
def _(t: Tables):
    """A page of a response: its size is an argument."""
    nudged = t.forecasts.withColumn("forecast_ensemble", F.col("forecast_ensemble") + 1e-9)
    return sv.response_rows(nudged, "forecast_ensemble", 90, limit=1000)


@check("lim6_response_all", RESPONSE.format(where="", days=90), views=("forecasts",))
def _(t: Tables):
    nudged = t.forecasts.withColumn("forecast_ensemble", F.col("forecast_ensemble") + 1e-9)
    return sv.response_rows(nudged, "forecast_ensemble", 90)


@check("prj13_positive_costs", "SELECT segment, holding_cost FROM inv WHERE holding_cost > 0", {"holding_cost": 4}, ("inv",))
def _(t: Tables):
    return sv.positive_costs(reorder_plan(safety_stock(t.forecasts))).select("segment", "holding_cost")


@check("prj14_filter_options", """
SELECT 'date' AS kind, CAST(MIN(date) AS VARCHAR) AS value FROM forecasts UNION ALL SELECT 'date', CAST(MAX(date) AS VARCHAR) FROM forecasts
UNION ALL SELECT DISTINCT 'store', CAST(store_nbr AS VARCHAR) FROM forecasts UNION ALL SELECT DISTINCT 'family', family FROM forecasts""", views=("forecasts",))
def _(t: Tables):
    o = sv.filter_options(t.forecasts)
    dates = o["dates"].select(F.lit("date").alias("kind"), F.explode(F.array(F.col("min_date").cast("string"), F.col("max_date").cast("string"))).alias("value"))
    stores = o["stores"].select(F.lit("store").alias("kind"), F.col("store_nbr").cast("string").alias("value"))
    return dates.unionByName(stores).unionByName(o["families"].select(F.lit("family").alias("kind"), F.col("family").alias("value")))


@check("agg4_daily_series", "SELECT date, SUM(sales) AS sales, SUM(forecast_ensemble) AS forecast_ensemble, SUM(forecast_lower) AS forecast_lower, SUM(forecast_upper) AS forecast_upper FROM forecasts GROUP BY date",
       {"forecast_ensemble": 5, "forecast_lower": 5, "forecast_upper": 5}, ("forecasts",))
def _(t: Tables):
    return sv.daily_series(t.forecasts)


_HEATMAP = """
WITH top AS (SELECT store_nbr FROM forecasts GROUP BY store_nbr {top}),
g AS (SELECT store_nbr, date FROM top CROSS JOIN (SELECT DISTINCT date FROM forecasts) d)
SELECT g.store_nbr, g.date, COALESCE(SUM(f.sales), 0) AS sales FROM g LEFT JOIN forecasts f USING (store_nbr, date) GROUP BY 1, 2"""


@check("agg5_store_heatmap", _HEATMAP.format(top="ORDER BY SUM(sales) DESC, store_nbr LIMIT 20"), views=("forecasts",))
def _(t: Tables):
    return sv.store_heatmap(t.forecasts, top=20)


@check("agg5_all_stores_heatmap", _HEATMAP.format(top=""), views=("forecasts",))
def _(t: Tables):
    return sv.store_heatmap(t.forecasts)


@check("agg6_forecast_profile", "SELECT COUNT(*) AS forecast_rows, COUNT(DISTINCT store_nbr) AS forecast_stores, MIN(date) AS start_date, MAX(date) AS end_date FROM forecasts", views=("forecasts",))
def _(t: Tables):
    return sv.forecast_profile(t.forecasts)


_TOTALS = """
SELECT round(SUM(day), 2) AS total_forecasted_sales, round(AVG(day), 2) AS avg_daily_forecast, MIN(date) AS start_date, MAX(date) AS end_date,
       (SELECT COUNT(DISTINCT store_nbr) FROM {src}) AS stores_included, (SELECT COUNT(DISTINCT family) FROM {src}) AS categories_included
FROM (SELECT date, SUM(forecast_ensemble) AS day FROM {src} GROUP BY date) d"""


@check("agg7_predict_totals", _TOTALS.format(src="forecasts"), views=("forecasts",))
def _(t: Tables):
    return sv.response_totals(t.forecasts, "forecast_ensemble")


@check("agg8_interval_summary", "SELECT CAST(0.95 AS DOUBLE) AS confidence_level, round(AVG(forecast_lower), 2) AS avg_lower, round(AVG(forecast_upper), 2) AS avg_upper, round(AVG(forecast_upper - forecast_lower), 2) AS avg_width FROM forecasts", views=("forecasts",))
def _(t: Tables):
    return sv.interval_summary(t.forecasts)


@check("dom13_forecast_rows", RESPONSE.format(where="WHERE store_nbr IN (1, 2, 3)", days=7), views=("forecasts",))
def _(t: Tables):
    nudged = t.forecasts.withColumn("forecast_ensemble", F.col("forecast_ensemble") + 1e-9)
    rows, _ = sv.forecast_request(nudged, store_ids=[1, 2, 3], horizon_days=7)
    return rows


@check("dom13_forecast_summary", f"""
WITH a AS (SELECT * FROM forecasts WHERE store_nbr IN (1, 2, 3)), c AS (SELECT * FROM a WHERE date < (SELECT min(date) FROM a) + 7), s AS ({_TOTALS.format(src='c')}),
i AS (SELECT CAST(0.95 AS DOUBLE) AS confidence_level, round(AVG(forecast_lower), 2) AS avg_lower, round(AVG(forecast_upper), 2) AS avg_upper, round(AVG(forecast_upper - forecast_lower), 2) AS avg_width FROM c)
SELECT 'ensemble' AS model_used, (SELECT COUNT(*) FROM c) AS forecast_count, s.*, i.* FROM s, i""", views=("forecasts",))
def _(t: Tables):
    _, summary = sv.forecast_request(t.forecasts, store_ids=[1, 2, 3], horizon_days=7)
    return summary


@check("dom14_optimize_totals", """
SELECT COUNT(*) AS segments_optimized, round(SUM(safety_stock), 2) AS total_safety_stock, round(SUM(holding_cost), 2) AS total_annual_holding_cost,
       r.total_segments, r.high_risk, r.medium_risk, r.low_risk, r.total_weekly_exposure, r.avg_risk_score
FROM inv, (SELECT COUNT(*) AS total_segments, COUNT(*) FILTER (WHERE risk_category = 'HIGH') AS high_risk, COUNT(*) FILTER (WHERE risk_category = 'MEDIUM') AS medium_risk,
                  COUNT(*) FILTER (WHERE risk_category = 'LOW') AS low_risk, round(SUM(weekly_revenue_at_risk), 2) AS total_weekly_exposure, round(AVG(composite_risk_score), 2) AS avg_risk_score
           FROM risk WHERE segment IN (1, 2, 3)) r
WHERE segment IN (1, 2, 3) GROUP BY ALL""", views=("inv", "risk"))
def _(t: Tables):
    _, totals = sv.optimize_request(t.forecasts, store_ids=[1, 2, 3])
    return totals


def _risk(t: Tables):
    f = stage(t.forecasts, "forecasts")
    return fin.stockout_risk(f, safety_stock(f))


@check("agg9_risk_summary", """
SELECT COUNT(*) AS total_segments, COUNT(*) FILTER (WHERE risk_category = 'HIGH') AS high_risk, COUNT(*) FILTER (WHERE risk_category = 'MEDIUM') AS medium_risk,
       COUNT(*) FILTER (WHERE risk_category = 'LOW') AS low_risk, round(SUM(weekly_revenue_at_risk), 2) AS total_weekly_exposure, round(AVG(composite_risk_score), 2) AS avg_risk_score FROM risk""", views=("risk",))
def _(t: Tables):
    return sv.risk_summary(_risk(t))


@check("agg10_inventory_totals", "SELECT COUNT(*) AS segments_optimized, round(SUM(safety_stock), 2) AS total_safety_stock, round(SUM(holding_cost), 2) AS total_annual_holding_cost FROM inv", views=("inv",))
def _(t: Tables):
    return sv.inventory_totals(reorder_plan(safety_stock(t.forecasts)))


@check("agg11_forecast_kpis", "SELECT SUM(sales) AS actual_sales, SUM(forecast_ensemble) AS forecasted_sales, ABS(SUM(sales) - SUM(forecast_ensemble)) / SUM(sales) * 100 AS error_pct, COUNT(*) AS records FROM forecasts",
       {"forecasted_sales": 3, "error_pct": 6}, ("forecasts",))
def _(t: Tables):
    return sv.forecast_kpis(t.forecasts, "forecast_ensemble")


@check("agg12_inventory_kpis", "SELECT AVG(inventory_turnover) AS avg_turnover, AVG(days_of_supply) AS avg_days_of_supply, SUM(holding_cost) AS total_holding_cost, SUM(safety_stock_cost) AS total_safety_stock_cost FROM inv",
       {"avg_turnover": 6, "avg_days_of_supply": 6, "total_holding_cost": 4, "total_safety_stock_cost": 4}, ("inv",))
def _(t: Tables):
    return sv.inventory_kpis(reorder_plan(safety_stock(t.forecasts)))


_BY_CATEGORY = """
SELECT l.risk_category, COUNT(r.segment) AS segments, COALESCE(AVG(r.composite_risk_score), 0) AS avg_score
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) l(risk_category) LEFT JOIN risk r USING (risk_category) GROUP BY 1"""


@check("agg13_score_by_category", _BY_CATEGORY, {"avg_score": 5}, ("risk",))
def _(t: Tables):
    return sv.risk_by_category(_risk(t))


@check("agg14_category_counts", f"SELECT risk_category, segments FROM ({_BY_CATEGORY}) c", views=("risk",))
def _(t: Tables):
    return sv.risk_by_category(_risk(t)).select("risk_category", "segments")


@check("lim7_latest_rows", "SELECT date, store_nbr, family, sales FROM forecasts ORDER BY date DESC, store_nbr, family LIMIT 500", views=("forecasts",))
def _(t: Tables):
    return sv.latest_rows(t.forecasts.select(*KEYS, "sales"), 500)


@check("lim7_rows_by_date", "SELECT date, store_nbr, family, sales FROM forecasts", views=("forecasts",))
def _(t: Tables):
    return sv.latest_rows(t.forecasts.select(*KEYS, "sales"), None)


@check("lim8_ranked_methods", "SELECT CAST(row_number() OVER (ORDER BY total_cost_of_errors, method) AS INT) AS place, method, total_cost_of_errors FROM comparison",
       {"total_cost_of_errors": COMP["total_cost_of_errors"]}, ("comparison",))
def _(t: Tables):
    """One row per method, so one task may number them."""
    ranked = sv.ranked_by(_comparison(t), "total_cost_of_errors").select("method", "total_cost_of_errors")
    return ranked.select(F.row_number().over(Window.orderBy("total_cost_of_errors", "method")).alias("place"), "*")


@check("set3_savings_waterfall", """
SELECT 'Holding Cost Savings' AS category, 'relative' AS measure, round(holding_cost_savings, 1) AS value FROM savings
UNION ALL SELECT 'Stockout Cost Savings', 'relative', round(stockout_cost_savings, 1) FROM savings
UNION ALL SELECT 'Capital Cost Saved', 'relative', round(working_capital_cost_saved, 1) FROM savings
UNION ALL SELECT 'Total Annual Savings', 'total', round(annualized_savings_estimate, 0) FROM savings""", views=("savings",))
def _(t: Tables):
    rows = sv.savings_waterfall(fin.savings(_comparison(t)))
    value = F.when(F.col("measure") == "total", F.round("value", 0)).otherwise(F.round("value", 1))
    return rows.select("category", "measure", value.alias("value"))


def _from_json(path: str, kind: str, name: str):
    return F.get_json_object("payload", path).cast(kind).alias(name)


@check("scl22_forecast_payload", """
SELECT SUM(sales) AS total_sales, COUNT(DISTINCT store_nbr) AS stores, MIN(date) || ' to ' || MAX(date) AS period, COUNT(*) AS records,
       (SELECT rmse FROM comparison WHERE method = 'AI Ensemble') AS rmse, (SELECT mape FROM comparison WHERE method = 'Seasonal Naive') AS mape
FROM forecasts""", {"rmse": 6, "mape": 6}, ("forecasts", "comparison"))
def _(t: Tables):
    """The forecast context as JSON, read back field by field."""
    f = stage(t.forecasts, "forecasts")
    payload = sv.forecast_context(f, optimize_inventory(f)["comparison"])
    return payload.select(
        _from_json("$.forecast_summary.total_sales", "double", "total_sales"),
        _from_json("$.forecast_summary.stores", "bigint", "stores"),
        _from_json("$.forecast_summary.period", "string", "period"),
        _from_json("$.forecast_summary.records", "bigint", "records"),
        _from_json("$.model_comparison['AI Ensemble'].rmse", "double", "rmse"),
        _from_json("$.model_comparison['Seasonal Naive'].mape", "double", "mape"),
    )


@check("scl22_inventory_payload", """
SELECT 'inventory' AS kind, savings_pct, (SELECT COUNT(*) FROM risk) AS segments FROM savings
UNION ALL SELECT 'question', savings_pct, (SELECT COUNT(DISTINCT store_nbr) FROM forecasts) FROM savings
UNION ALL SELECT 'week', savings_pct, (SELECT COUNT(*) FROM forecasts) FROM savings""", {"savings_pct": 6}, ("savings", "risk", "forecasts"))
def _(t: Tables):
    """The inventory, question and weekly contexts as JSON, read back field by field."""
    f = stage(t.forecasts, "forecasts")
    r = optimize_inventory(f)
    weekly = sv.weekly_context("1998-12-27", sv.forecast_kpis(f, "forecast_ensemble"), sv.inventory_kpis(r["inventory"]), r["savings"])
    asked = sv.question_context("Which stores need attention?", r["savings"], r["executive_summary"], f)
    inventory = sv.inventory_context(r["savings"], r["executive_summary"])

    def fields(payload, kind, savings, segments):
        return payload.select(
            F.lit(kind).alias("kind"), _from_json(savings, "double", "savings_pct"), _from_json(segments, "bigint", "segments")
        )

    return (
        fields(inventory, "inventory", "$.savings.savings_pct", "$.risk_summary.total_segments")
        .unionByName(fields(asked, "question", "$.data.savings.savings_pct", "$.data.total_stores"))
        .unionByName(fields(weekly, "week", "$.financial.savings_pct", "$.forecast.records"))
    )


@check("snk5_forecasts_csv", "SELECT date, store_nbr, family, forecast_ensemble FROM forecasts", {"forecast_ensemble": 6}, ("forecasts",))
def _(t: Tables):
    path = sinks.write_csv(t.forecasts.select(*KEYS, "forecast_ensemble"), new_path(t.spark, "forecasts_csv"))
    return t.spark.read.option("header", True).schema("date date, store_nbr int, family string, forecast_ensemble double").csv(path)
