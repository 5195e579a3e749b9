"""Safety stock, reorder, finance, risk and summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from shelfcast.functions.scalar import money, percent
from shelfcast.functions.service_level import Z_TABLE, z_score, z_value
from shelfcast.operators import finance as fin
from shelfcast.operators import reorder as ro
from shelfcast.operators.safety_stock import (
    SafetyStockSettings,
    demand_and_lead_time,
    forecast_error,
    safety_stock,
    standard,
)
from shelfcast.plans.optimize import optimize_inventory
from shelfcast.sources import readers, schemas, sinks
from shelfcast.sources.storage import new_path, stage

LEVELS = {1: 0.99, 2: 0.90, 3: 0.875}
_Z_CASE = "CASE " + " ".join(f"WHEN service_level = {k} THEN {v}" for k, v in Z_TABLE.items())
_Z_CASE += f" WHEN service_level = 0.875 THEN {z_value(0.875)!r} END"


def _stock_sql(method: str, levels: str = "CAST(0.95 AS DOUBLE)", lead: int = 7, segment: str = "store_nbr") -> str:
    formula = {
        "standard": f"z * demand_std * sqrt({lead})",
        "demand_and_lead_time": f"z * sqrt({lead} * demand_std * demand_std + avg_daily_demand * avg_daily_demand * 4)",
        "forecast_error": f"z * GREATEST(forecast_error_std, mad * 1.25) * sqrt({lead})",
    }[method]
    return f"""
SELECT segment, '{segment}' AS segment_col, avg_daily_demand, demand_std, forecast_error_std, forecast_mape, service_level, z AS z_score,
       CAST({lead} AS INT) AS lead_time_days, safety_stock, CASE WHEN avg_daily_demand > 0 THEN safety_stock / avg_daily_demand ELSE 0 END AS safety_stock_days,
       '{method}' AS method, n_observations
FROM (SELECT *, CAST(GREATEST(CEIL({formula}), 0) AS DOUBLE) AS safety_stock
      FROM (SELECT *, CAST({_Z_CASE} AS DOUBLE) AS z
            FROM (SELECT {segment} AS segment, AVG(sales) AS avg_daily_demand, STDDEV_POP(sales) AS demand_std, STDDEV_POP(sales - forecast_ensemble) AS forecast_error_std,
                         AVG(ABS(sales - forecast_ensemble)) AS mad, COALESCE(AVG(CASE WHEN sales > 0 THEN ABS(sales - forecast_ensemble) / sales END), 0) AS forecast_mape,
                         {levels} AS service_level, COUNT(*) AS n_observations
                  FROM forecasts GROUP BY {segment}) a) b) c"""


LEVEL_SQL = "CAST(CASE {0} WHEN 1 THEN 0.99 WHEN 2 THEN 0.90 WHEN 3 THEN 0.875 ELSE 0.95 END AS DOUBLE)"


def _plan_sql(source: str, lead: int = 7) -> str:
    return f"""
SELECT segment, avg_daily_demand, safety_stock, CAST(GREATEST(CEIL(avg_daily_demand * {lead} + safety_stock), 0) AS DOUBLE) AS reorder_point, q AS eoq,
       CAST(GREATEST(CEIL(avg_daily_demand * (7 + {lead}) + safety_stock), 0) AS DOUBLE) AS order_up_to_level,
       avg_daily_demand * 30 AS demand_next_30d, d AS annual_demand, service_level,
       CASE WHEN q > 0 THEN d / q END AS n_orders_per_year, CASE WHEN q > 0 THEN d / q * 50.0 ELSE 0 END AS ordering_cost,
       CASE WHEN q > 0 THEN (q / 2 + safety_stock) * 2.5 ELSE 0 END AS holding_cost, CASE WHEN q > 0 THEN safety_stock * 2.5 ELSE 0 END AS safety_stock_cost,
       CASE WHEN q > 0 THEN d * 10.0 ELSE 0 END AS product_cost,
       CASE WHEN q > 0 THEN d / q * 50.0 + (q / 2 + safety_stock) * 2.5 + d * 10.0 ELSE 0 END AS total_cost,
       CASE WHEN q > 0 THEN q / 2 + safety_stock END AS avg_inventory_units,
       CASE WHEN q > 0 THEN d / (q / 2 + safety_stock) END AS inventory_turnover,
       CASE WHEN q > 0 THEN CASE WHEN d > 0 THEN (q / 2 + safety_stock) / (d / 365) ELSE 0 END END AS days_of_supply
FROM (SELECT *, avg_daily_demand * 365 AS d,
             CAST(CASE WHEN avg_daily_demand > 0 THEN GREATEST(CEIL(SQRT(2 * avg_daily_demand * 365 * 50.0 / 2.5)), 1) ELSE 0 END AS DOUBLE) AS q
      FROM {source}) s"""


VIEWS["ss"] = (_stock_sql("forecast_error"), ("forecasts",))
VIEWS["inv"] = (_plan_sql("ss"), ("ss",))
VIEWS["baselines"] = ("""
SELECT date, store_nbr, family, sales, forecast_ensemble, AVG(sales) OVER () AS naive,
       COALESCE(LAG(sales, 7) OVER (PARTITION BY store_nbr ORDER BY date, family), AVG(sales) OVER (PARTITION BY store_nbr)) AS seasonal_naive
FROM forecasts""", ("forecasts",))
VIEWS["comparison"] = ("""
WITH u AS (SELECT 'AI Ensemble' AS method, sales AS a, forecast_ensemble AS f FROM baselines
           UNION ALL SELECT 'Naive (Last Period)', sales, naive FROM baselines
           UNION ALL SELECT 'Seasonal Naive', sales, seasonal_naive FROM baselines),
g AS (SELECT method, COUNT(*) AS n, COALESCE(AVG(CASE WHEN a > 0 THEN ABS(a - f) / a END), 1.0) AS mape,
             SUM(GREATEST(f - a, 0)) AS o, SUM(GREATEST(a - f, 0)) AS u, SQRT(AVG((a - f) * (a - f))) AS rmse FROM u GROUP BY method)
SELECT method, mape, 1 - mape AS forecast_accuracy, o AS total_over_forecast_units, u AS total_under_forecast_units,
       o * 10.0 * 0.25 / 365 * n AS excess_inventory_cost, u * 5.0 * 1.5 AS stockout_cost,
       o * 10.0 * 0.25 / 365 * n + u * 5.0 * 1.5 AS total_cost_of_errors, rmse
FROM g""", ("baselines",))
VIEWS["savings"] = ("""
SELECT b.excess_inventory_cost - a.excess_inventory_cost AS holding_cost_savings, b.stockout_cost - a.stockout_cost AS stockout_cost_savings,
       b.total_cost_of_errors - a.total_cost_of_errors AS total_direct_savings, (a.forecast_accuracy - b.forecast_accuracy) * 100 AS accuracy_improvement_pct,
       b.total_over_forecast_units - a.total_over_forecast_units AS excess_inventory_reduction_units,
       (b.total_over_forecast_units - a.total_over_forecast_units) * 10.0 AS working_capital_freed,
       (b.total_over_forecast_units - a.total_over_forecast_units) * 10.0 * 0.08 AS working_capital_cost_saved,
       (b.total_cost_of_errors - a.total_cost_of_errors) * (365.0::DOUBLE / 16) AS annualized_savings_estimate,
       (b.total_over_forecast_units - a.total_over_forecast_units) * 10.0 * (365.0::DOUBLE / 16) AS annualized_capital_freed,
       CASE WHEN b.total_cost_of_errors > 0 THEN (b.total_cost_of_errors - a.total_cost_of_errors) / b.total_cost_of_errors * 100 ELSE 0 END AS savings_pct
FROM comparison a, comparison b WHERE a.method = 'AI Ensemble' AND b.method = 'Naive (Last Period)'""", ("comparison",))
VIEWS["halves"] = ("""
SELECT store_nbr AS segment, COUNT(*) AS n_rows, AVG(CASE WHEN p <= n // 2 THEN forecast_ensemble END) AS first_half,
       AVG(CASE WHEN p > n // 2 THEN forecast_ensemble END) AS second_half
FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr ORDER BY date, family) AS p, COUNT(*) OVER (PARTITION BY store_nbr) AS n FROM forecasts) x
GROUP BY store_nbr""", ("forecasts",))
VIEWS["risk"] = ("""
WITH j AS (SELECT ss.*, h.n_rows, (second_half - first_half) / (first_half + 1e-6::DOUBLE) * 100 AS trend FROM ss JOIN halves h ON h.segment IS NOT DISTINCT FROM ss.segment),
c AS (SELECT segment, avg_daily_demand, safety_stock,
             LEAST(100, CASE WHEN avg_daily_demand > 0 THEN forecast_error_std / avg_daily_demand ELSE 1 END * 100) AS variability_risk,
             GREATEST(0, 100 - safety_stock / (forecast_error_std + 1e-6::DOUBLE) * 30) AS adequacy_risk,
             CASE WHEN n_rows >= 7 THEN GREATEST(0, LEAST(100, trend * 2)) ELSE 50 END AS trend_risk,
             LEAST(100, avg_daily_demand / 500 * 100) AS volume_risk, CASE WHEN n_rows >= 7 THEN trend ELSE 0 END AS demand_trend_pct, n_rows >= 7 AS trend_known FROM j),
s AS (SELECT *, variability_risk * 0.35::DOUBLE + adequacy_risk * 0.30::DOUBLE + trend_risk * 0.20::DOUBLE + volume_risk * 0.15::DOUBLE AS composite_risk_score FROM c)
SELECT *, CASE WHEN composite_risk_score >= 70 THEN 'HIGH' WHEN composite_risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category,
       CASE WHEN composite_risk_score >= 70 THEN 'Increase safety stock by 20-30%' WHEN composite_risk_score >= 40 THEN 'Monitor closely, consider 10% buffer' ELSE 'Current levels adequate' END AS recommendation,
       avg_daily_demand * 5.0 AS daily_revenue_at_risk, avg_daily_demand * 5.0 * 7 AS weekly_revenue_at_risk
FROM s""", ("ss", "halves"))
VIEWS["top5"] = ("SELECT segment, composite_risk_score, risk_category, weekly_revenue_at_risk FROM risk ORDER BY composite_risk_score DESC, segment LIMIT 5", ("risk",))

SS = {c: 6 for c in ("avg_daily_demand", "demand_std", "forecast_error_std", "forecast_mape", "safety_stock_days", "z_score")}
INV = {c: 4 for c in (
    "avg_daily_demand", "demand_next_30d", "annual_demand", "n_orders_per_year", "ordering_cost", "holding_cost",
    "safety_stock_cost", "product_cost", "total_cost", "avg_inventory_units", "inventory_turnover", "days_of_supply")}
COMP = {"mape": 6, "forecast_accuracy": 6, "total_over_forecast_units": 3, "total_under_forecast_units": 3,
        "excess_inventory_cost": 1, "stockout_cost": 2, "total_cost_of_errors": 1, "rmse": 6}
SAVE = {"holding_cost_savings": 1, "stockout_cost_savings": 2, "total_direct_savings": 1, "accuracy_improvement_pct": 4,
        "excess_inventory_reduction_units": 3, "working_capital_freed": 2, "working_capital_cost_saved": 2,
        "annualized_savings_estimate": 0, "annualized_capital_freed": 1, "savings_pct": 6}
RISK = {c: 5 for c in ("avg_daily_demand", "variability_risk", "adequacy_risk", "trend_risk", "volume_risk",
                       "demand_trend_pct", "composite_risk_score", "daily_revenue_at_risk", "weekly_revenue_at_risk")}


def _segments(t: Tables):
    """Demand statistics of each store, the input of the scalar formulas."""
    f = t.forecasts
    error = F.col("sales") - F.col("forecast_ensemble")
    return f.groupBy(F.col("store_nbr").alias("segment")).agg(
        F.avg("sales").alias("d"), F.stddev_pop("sales").alias("sd"), F.stddev_pop(error).alias("se"),
        F.avg(F.abs(error)).alias("mad"),
    )


VIEWS["seg"] = ("""
SELECT store_nbr AS segment, AVG(sales) AS d, STDDEV_POP(sales) AS sd, STDDEV_POP(sales - forecast_ensemble) AS se, AVG(ABS(sales - forecast_ensemble)) AS mad
FROM forecasts GROUP BY store_nbr""", ("forecasts",))


@check("scl12_z_score", f"""
SELECT segment, service_level, CAST({_Z_CASE} AS DOUBLE) AS z_score
FROM (SELECT segment, {LEVEL_SQL.format('segment')} AS service_level FROM seg) s""", {"z_score": 6}, ("seg",))
def _(t: Tables):
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("segment")], F.lit(0.95))
    return _segments(t).select("segment", level.alias("service_level")).withColumn("z_score", z_score(F.col("service_level")))


@check("scl13_standard_stock", "SELECT segment, CAST(GREATEST(CEIL(1.645 * sd * SQRT(7)), 0) AS DOUBLE) AS safety_stock FROM seg", views=("seg",))
def _(t: Tables):
    return _segments(t).select("segment", standard(F.lit(1.645), F.col("sd"), F.lit(7.0)).alias("safety_stock"))


@check("scl14_lead_time_stock", "SELECT segment, CAST(GREATEST(CEIL(1.645 * SQRT(7 * sd * sd + d * d * 4)), 0) AS DOUBLE) AS safety_stock FROM seg", views=("seg",))
def _(t: Tables):
    stock = demand_and_lead_time(F.lit(1.645), F.col("d"), F.col("sd"), F.lit(7.0), F.lit(2.0))
    return _segments(t).select("segment", stock.alias("safety_stock"))


@check("scl15_forecast_error_stock", "SELECT segment, CAST(GREATEST(CEIL(1.645 * GREATEST(se, 1.25 * mad) * SQRT(7)), 0) AS DOUBLE) AS safety_stock FROM seg", views=("seg",))
def _(t: Tables):
    return _segments(t).select("segment", forecast_error(F.lit(1.645), F.col("se"), F.col("mad"), F.lit(7.0)).alias("safety_stock"))


@check("scl16_reorder_point", "SELECT segment, reorder_point FROM inv", views=("inv",))
def _(t: Tables):
    s = safety_stock(t.forecasts)
    return s.select("segment", ro.reorder_point(F.col("avg_daily_demand"), F.col("safety_stock"), 7).alias("reorder_point"))


@check("scl17_eoq", "SELECT segment, eoq FROM inv", views=("inv",))
def _(t: Tables):
    s = safety_stock(t.forecasts)
    return s.select("segment", ro.economic_order_quantity(F.col("avg_daily_demand") * 365, 50.0, 2.5).alias("eoq"))


@check("scl18_order_up_to", "SELECT segment, order_up_to_level FROM inv", views=("inv",))
def _(t: Tables):
    s = safety_stock(t.forecasts)
    return s.select("segment", ro.order_up_to_level(F.col("avg_daily_demand"), F.col("safety_stock"), 7, 7).alias("order_up_to_level"))


COST = ["n_orders_per_year", "ordering_cost", "holding_cost", "safety_stock_cost", "product_cost", "total_cost", "avg_inventory_units", "inventory_turnover", "days_of_supply"]


@check("scl19_total_costs", f"SELECT segment, {', '.join(COST)} FROM inv", {c: INV[c] for c in COST}, ("inv",))
def _(t: Tables):
    return ro.reorder_plan(safety_stock(t.forecasts)).select("segment", *COST)


@check("jn14_service_levels", _stock_sql("forecast_error", LEVEL_SQL.format("store_nbr")), SS, ("forecasts",))
def _(t: Tables):
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("store_nbr")]
    table = t.stores.select(F.col("store_nbr").alias("segment"), level.alias("service_level")).where(level.isNotNull())
    return safety_stock(t.forecasts, service_levels=table)


@check("dom5_safety_stock", _stock_sql("forecast_error"), SS, ("forecasts",))
def _(t: Tables):
    return safety_stock(t.forecasts)


@check("dom5_safety_stock_standard", _stock_sql("standard", segment="family"), SS, ("forecasts",))
def _(t: Tables):
    return safety_stock(t.forecasts, segment_col="family", method="standard")


@check("dom5_safety_stock_lead_time", _stock_sql("demand_and_lead_time", LEVEL_SQL.format("store_nbr")), SS, ("forecasts",))
def _(t: Tables):
    return safety_stock(t.forecasts, method="demand_and_lead_time", service_levels=LEVELS)


@check("dom6_reorder_points", "SELECT * FROM inv", INV, ("inv",))
def _(t: Tables):
    return ro.reorder_plan(safety_stock(t.forecasts))


@check("win11_seasonal_naive", "SELECT date, store_nbr, family, sales, seasonal_naive FROM baselines", {"seasonal_naive": 6}, ("baselines",))
def _(t: Tables):
    return fin.seasonal_naive(stage(t.forecasts.select("date", "store_nbr", "family", "sales"), "forecasts"))


@check("udf2_seasonal_naive_native", "SELECT date, store_nbr, family, seasonal_naive FROM baselines", {"seasonal_naive": 6}, ("baselines",))
def _(t: Tables):
    return fin.seasonal_naive(stage(t.forecasts.select("date", "store_nbr", "family", "sales"), "forecasts")).drop("sales")


@check("win14_half_means", "SELECT * FROM halves", {"first_half": 6, "second_half": 6}, ("halves",))
def _(t: Tables):
    return fin.half_means(stage(t.forecasts, "forecasts"))


@check("jn12_stock_and_forecasts", "SELECT segment, safety_stock, n_rows, first_half, second_half FROM ss JOIN halves USING (segment)", {"first_half": 6, "second_half": 6}, ("ss", "halves"))
def _(t: Tables):
    f = stage(t.forecasts, "forecasts")
    joined = safety_stock(f).join(fin.half_means(f), "segment")
    return joined.select("segment", "safety_stock", "n_rows", "first_half", "second_half")


def _comparison(t: Tables):
    f = stage(t.forecasts.select("date", "store_nbr", "family", "sales", "forecast_ensemble"), "forecasts")
    base = fin.seasonal_naive(f)
    mean = f.agg(F.avg("sales")).scalar()
    return fin.compare_methods(base, {fin.AI: "forecast_ensemble", fin.NAIVE: mean, fin.SEASONAL: "seasonal_naive"})


@check("dom7_compare_methods", "SELECT * FROM comparison", COMP, ("comparison",))
def _(t: Tables):
    return _comparison(t)


@check("dom8_savings", "SELECT * FROM savings", SAVE, ("savings",))
def _(t: Tables):
    return fin.savings(_comparison(t))


@check("dom9_stockout_risk", "SELECT * FROM risk", RISK, ("risk",))
def _(t: Tables):
    f = stage(t.forecasts, "forecasts")
    return fin.stockout_risk(f, safety_stock(f))


@check("lim3_top_risk_segments", "SELECT * FROM top5", {"composite_risk_score": 5, "weekly_revenue_at_risk": 5}, ("top5",))
def _(t: Tables):
    f = stage(t.forecasts, "forecasts")
    return fin.top_risks(fin.stockout_risk(f, safety_stock(f)))


SUMMARY = {"annual_savings_estimate": 0, "forecast_accuracy_improvement": 4, "working_capital_freed": 1, "cost_reduction_pct": 6,
           "avg_inventory_turnover": 5, "avg_days_of_supply": 5, "total_safety_stock_cost": 4, "total_weekly_exposure": 4, "top_score": 5}


def _optimized(t: Tables):
    return optimize_inventory(stage(t.forecasts, "forecasts"))


@check("agg23_executive_summary", """
SELECT s.annualized_savings_estimate AS annual_savings_estimate, s.accuracy_improvement_pct AS forecast_accuracy_improvement,
       s.annualized_capital_freed AS working_capital_freed, s.savings_pct AS cost_reduction_pct,
       i.t AS avg_inventory_turnover, i.d AS avg_days_of_supply, i.c AS total_safety_stock_cost,
       r.h AS high_risk_segments, r.n AS total_segments, r.e AS total_weekly_exposure,
       (SELECT segment FROM top5 ORDER BY composite_risk_score DESC, segment LIMIT 1) AS top_segment, (SELECT MAX(composite_risk_score) FROM top5) AS top_score,
       (SELECT string_agg(CAST(segment AS VARCHAR), ',' ORDER BY composite_risk_score DESC, segment) FROM top5) AS top_segments
FROM savings s, (SELECT AVG(inventory_turnover) AS t, AVG(days_of_supply) AS d, SUM(safety_stock_cost) AS c FROM inv) i,
     (SELECT COUNT(*) FILTER (WHERE risk_category = 'HIGH') AS h, COUNT(*) AS n, SUM(weekly_revenue_at_risk) AS e FROM risk) r
""", SUMMARY, ("savings", "inv", "risk", "top5"))
def _(t: Tables):
    top = F.col("risk_summary.top_risk_segments")
    return _optimized(t)["executive_summary"].select(
        "headline_metrics.*", "inventory_health.*", "risk_summary.high_risk_segments", "risk_summary.total_segments",
        "risk_summary.total_weekly_exposure", top[0]["segment"].alias("top_segment"),
        top[0]["composite_risk_score"].alias("top_score"),
        F.array_join(F.transform(top, lambda x: x["segment"].cast("string")), ",").alias("top_segments"),
    )


@check("dom10_recommendations", """
WITH h AS (SELECT COUNT(*) FILTER (WHERE risk_category = 'HIGH') AS n FROM risk)
SELECT 'HIGH' AS priority, 'Implement AI-driven reorder system across all stores' AS action, '$' || format('{:,}', CAST(round(annualized_savings_estimate, 0) AS BIGINT)) || ' annual savings' AS impact FROM savings WHERE annualized_savings_estimate > 10000
UNION ALL SELECT 'HIGH', 'Review safety stock levels for ' || n || ' high-risk segments', 'Prevent potential stockouts and revenue loss' FROM h WHERE n > 0
UNION ALL SELECT 'MEDIUM', 'Transition from manual to AI-based demand planning', printf('%.1f', accuracy_improvement_pct) || '% accuracy improvement' FROM savings WHERE accuracy_improvement_pct > 5
UNION ALL SELECT 'MEDIUM', 'Set up automated weekly model retraining pipeline', 'Maintain forecast accuracy as patterns evolve'
""", views=("savings", "risk"))
def _(t: Tables):
    return _optimized(t)["executive_summary"].select(F.inline("recommendations"))


TOTALS = {"avg_turnover": 5, "avg_days_of_supply": 5, "total_ordering_cost": 3, "total_holding_cost": 3,
          "total_weekly_exposure": 4, "avg_safety_stock_days": 6}


@check("agg24_result_summary", """
SELECT i.*, r.*, s.*
FROM (SELECT AVG(inventory_turnover) AS avg_turnover, AVG(days_of_supply) AS avg_days_of_supply, SUM(ordering_cost) AS total_ordering_cost, SUM(holding_cost) AS total_holding_cost FROM inv) i,
     (SELECT COUNT(*) FILTER (WHERE risk_category = 'HIGH') AS high_risk, COUNT(*) FILTER (WHERE risk_category = 'MEDIUM') AS medium_risk,
             COUNT(*) FILTER (WHERE risk_category = 'LOW') AS low_risk, SUM(weekly_revenue_at_risk) AS total_weekly_exposure FROM risk) r,
     (SELECT COUNT(*) AS segments, SUM(safety_stock) AS total_safety_stock, AVG(safety_stock_days) AS avg_safety_stock_days FROM ss) s
""", TOTALS, ("inv", "risk", "ss"))
def _(t: Tables):
    r = _optimized(t)
    return fin.result_summary(r["risk"], r["inventory"], r["safety_stock"])


@check("dom11_optimize_inventory", """
SELECT i.*, r.risk_category, r.composite_risk_score, s.annualized_savings_estimate
FROM inv i JOIN risk r USING (segment), savings s""", {**INV, "composite_risk_score": 5, "annualized_savings_estimate": 0}, ("inv", "risk", "savings"))
def _(t: Tables):
    r = _optimized(t)
    saved = r["savings"].select("annualized_savings_estimate").scalar()
    risk = r["risk"].select("segment", "risk_category", "composite_risk_score")
    return r["inventory"].join(risk, "segment").withColumn("annualized_savings_estimate", saved)


@check("snk4_save_results", "SELECT r.*, i.eoq, i.total_cost FROM risk r JOIN inv i USING (segment)", {**RISK, "total_cost": 4}, ("risk", "inv"))
def _(t: Tables):
    folder = new_path(t.spark, "results")
    sinks.write_results(_optimized(t), folder)
    inv = readers.read_table_or_empty(t.spark, f"{folder}/inventory_recommendations.parquet", schemas.INVENTORY)
    risk = readers.read_table_or_empty(t.spark, f"{folder}/stockout_risk.parquet", schemas.RISK)
    return risk.join(inv.select("segment", "eoq", "total_cost"), "segment")


@check("src3_segment_tables", "SELECT * FROM inv", INV, ("inv",))
def _(t: Tables):
    path = sinks.write_parquet(ro.reorder_plan(safety_stock(t.forecasts)), new_path(t.spark, "inventory"))
    stored = readers.read_table_or_empty(t.spark, path, schemas.INVENTORY)
    return stored.unionByName(readers.read_table_or_empty(t.spark, path + "-missing", schemas.INVENTORY))


@check("src4_financial_document", """
SELECT c.method, c.total_cost_of_errors, s.savings_pct, (SELECT COUNT(*) FROM risk) AS total_segments
FROM comparison c, savings s""", {"total_cost_of_errors": 1, "savings_pct": 6}, ("comparison", "savings", "risk"))
def _(t: Tables):
    path = new_path(t.spark, "financial_impact.json")
    _optimized(t)["document"].write.json(path)
    doc = readers.read_financial_document(t.spark, path)
    return doc.select(
        F.explode("comparison").alias("method", "m"), F.col("savings.savings_pct").alias("savings_pct"),
        F.col("executive_summary.risk_summary.total_segments").alias("total_segments"),
    ).select("method", F.col("m.total_cost_of_errors").alias("total_cost_of_errors"), "savings_pct", "total_segments")


@check("dom14_optimize_request", f"""
WITH s AS ({_stock_sql('forecast_error', 'CAST(0.99 AS DOUBLE)', 14)}), i AS ({_plan_sql('s', 14)})
SELECT * FROM i WHERE segment IN (1, 2, 3)""", INV, ("forecasts",))
def _(t: Tables):
    from shelfcast.operators.serving import optimize_request
    rows, _ = optimize_request(t.forecasts, store_ids=[1, 2, 3], service_level=0.99, lead_time_days=14)
    return rows


@check("scl20_money_text", """
WITH v AS (SELECT segment, total_cost * p AS v FROM inv, (VALUES (0.0), (0.01), (1.0), (100.0), (100000.0)) x(p))
SELECT segment, CASE WHEN v IS NULL OR v = 0 THEN '$0' WHEN abs(v) >= 1e9 THEN '$' || printf('%.2f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN '$' || printf('%.1f', v / 1e6) || 'M'
       WHEN abs(v) >= 1e3 THEN '$' || printf('%.0f', v / 1e3) || 'K' ELSE '$' || format('{:,}', CAST(round(v) AS BIGINT)) END AS amount, printf('%.1f', i.inventory_turnover) || '%' AS pct
FROM v JOIN inv i USING (segment)""", views=("inv",))
def _(t: Tables):
    inv = ro.reorder_plan(safety_stock(t.forecasts))
    factor = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.01, 1.0, 100.0, 100000.0)]))
    return inv.withColumn("p", factor).select(
        "segment", money(F.col("total_cost") * F.col("p")).alias("amount"), percent(F.col("inventory_turnover")).alias("pct"))
