"""Metrics, segment metrics and diagnostic aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from shelfcast.operators import diagnostics as dg
from shelfcast.operators import metrics as m
from shelfcast.operators.ordinal import with_global_position
from shelfcast.sources.storage import stage

KEYS = ["date", "store_nbr", "family"]


def family_sql(a: str, p: str) -> str:
    """Ensemble-family metrics of prediction p against a, as select items."""
    return f"""SQRT(AVG(({a}-{p})*({a}-{p}))) AS rmse, AVG(ABS({a}-{p})) AS mae, 1 - SUM(({a}-{p})*({a}-{p})) / (COUNT(*) * VAR_POP({a})) AS r2,
       COALESCE(AVG(CASE WHEN {a} > 0 THEN ABS({a}-{p})/{a} END), 'Infinity'::DOUBLE) AS mape,
       AVG(ABS({a}-{p}) / CASE WHEN ABS({a})+ABS({p}) = 0 THEN 1 ELSE (ABS({a})+ABS({p}))/2 END) AS smape,
       SUM(ABS({a}-{p})) / SUM(ABS({a})) AS wape, AVG({p}-{a}) AS bias, GREATEST(0, 1 - SUM(ABS({a}-{p})) / SUM(ABS({a}))) AS forecast_accuracy"""


FAMILY = {c: 6 for c in ("rmse", "mae", "r2", "mape", "smape", "wape", "bias", "forecast_accuracy")}

VIEWS["segment_metrics"] = ("""
SELECT store_nbr AS segment, COUNT(*) AS n_samples, CAST(0 AS BIGINT) AS n_missing, COUNT(*) >= 5 AS enough_rows, AVG(sales) AS avg_actual, AVG(forecast_ensemble) AS avg_predicted,
       SQRT(AVG((sales-forecast_ensemble)*(sales-forecast_ensemble))) AS rmse, AVG(ABS(sales-forecast_ensemble)) AS mae,
       COALESCE(AVG(CASE WHEN sales > 0 THEN ABS(sales-forecast_ensemble)/sales END), 'Infinity'::DOUBLE) AS mape, AVG(forecast_ensemble-sales) AS bias,
       CASE WHEN AVG(sales) > 0 THEN AVG(forecast_ensemble-sales)/AVG(sales)*100 ELSE 0 END AS bias_pct
FROM forecasts GROUP BY store_nbr""", ("forecasts",))
SEGMENT = {c: 6 for c in ("avg_actual", "avg_predicted", "rmse", "mae", "mape", "bias", "bias_pct")}


@check("met1_forecaster_metrics", """
WITH f AS (SELECT sales AS a, GREATEST(forecast_xgboost, 0) AS p FROM forecasts)
SELECT AVG(ABS(a-p)) AS mae, SQRT(AVG((a-p)*(a-p))) AS rmse, AVG(CASE WHEN a > 0 THEN ABS(a-p)/a END)*100 AS mape,
       AVG(2*ABS(a-p) / CASE WHEN ABS(a)+ABS(p) = 0 THEN 1 ELSE ABS(a)+ABS(p) END)*100 AS smape,
       1 - SUM((a-p)*(a-p)) / (COUNT(*)*VAR_POP(a)) AS r2, SQRT(AVG((ln(1+p)-ln(1+a))*(ln(1+p)-ln(1+a)))) AS rmsle
FROM f""", {"mae": 4, "rmse": 4, "mape": 4, "smape": 4, "r2": 4, "rmsle": 6}, ("forecasts",))
def _(t: Tables):
    return m.aggregate(t.forecasts, m.forecaster_metrics("sales", "forecast_xgboost"))


@check("met2_ensemble_metrics", f"SELECT {family_sql('sales', 'forecast_ensemble')} FROM forecasts", FAMILY, ("forecasts",))
def _(t: Tables):
    return m.aggregate(t.forecasts, m.ensemble_metrics("sales", "forecast_ensemble"))


VIEWS["evaluation"] = ("""
WITH f AS (SELECT store_nbr, family, date, sales AS a, forecast_ensemble AS p FROM forecasts),
d AS (SELECT sign(a - LAG(a) OVER w) AS da, sign(p - LAG(p) OVER w) AS dp FROM f WINDOW w AS (PARTITION BY store_nbr, family ORDER BY date))
SELECT SQRT(AVG((a-p)*(a-p))) AS rmse, AVG(ABS(a-p)) AS mae, 1 - SUM((a-p)*(a-p))/(COUNT(*)*VAR_POP(a)) AS r2,
       AVG(CASE WHEN a > 0 THEN ABS(a-p)/a END) AS mape, AVG(ABS(a-p) / CASE WHEN ABS(a)+ABS(p) = 0 THEN 1 ELSE (ABS(a)+ABS(p))/2 END) AS smape,
       SUM(ABS(a-p))/SUM(ABS(a)) AS wape, AVG(p-a) AS mean_bias, AVG(p-a)/AVG(a)*100 AS bias_pct,
       SUM(GREATEST(p-a,0)) AS total_over_forecast, AVG(GREATEST(p-a,0)) AS avg_over_forecast,
       SUM(GREATEST(a-p,0)) AS total_under_forecast, AVG(GREATEST(a-p,0)) AS avg_under_forecast,
       GREATEST(0, 1 - SUM(ABS(a-p))/SUM(ABS(a))) AS forecast_accuracy, quantile_cont(p-a, 0.5) AS median_bias,
       (SELECT AVG(CASE WHEN da = dp THEN 1.0::DOUBLE ELSE 0 END) FROM d WHERE da IS NOT NULL AND dp IS NOT NULL) AS directional_accuracy,
       quantile_cont(ABS(a-p), 0.5) AS error_p50, quantile_cont(ABS(a-p), 0.9) AS error_p90, quantile_cont(ABS(a-p), 0.95) AS error_p95, quantile_cont(ABS(a-p), 0.99) AS error_p99
FROM f""", ("forecasts",))
EVALUATION = {c: 6 for c in (
    "rmse", "mae", "r2", "mape", "smape", "wape", "mean_bias", "bias_pct", "avg_over_forecast", "avg_under_forecast",
    "forecast_accuracy", "median_bias", "directional_accuracy", "error_p50", "error_p90", "error_p95", "error_p99")}
EVALUATION.update({"total_over_forecast": 3, "total_under_forecast": 3})


@check("met3_evaluation", "SELECT * FROM evaluation", EVALUATION, ("evaluation",))
def _(t: Tables):
    return m.evaluate(stage(t.forecasts, "forecasts"))


@check("win12_directional_accuracy", "SELECT directional_accuracy FROM evaluation", {"directional_accuracy": 6}, ("evaluation",))
def _(t: Tables):
    return m.directional_accuracy(t.forecasts, "sales", "forecast_ensemble")


@check("win12_table_direction", """
WITH d AS (SELECT sign(sales - LAG(sales) OVER w) AS da, sign(forecast_ensemble - LAG(forecast_ensemble) OVER w) AS dp
           FROM forecasts WINDOW w AS (ORDER BY date, store_nbr, family))
SELECT AVG(CASE WHEN da = dp THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy FROM d WHERE da IS NOT NULL AND dp IS NOT NULL""",
       {"directional_accuracy": 6}, ("forecasts",))
def _(t: Tables):
    return m.directional_accuracy(t.forecasts, "sales", "forecast_ensemble", series=(), order=KEYS)


@check("met4_segment_metrics", "SELECT * FROM segment_metrics", SEGMENT, ("segment_metrics",))
def _(t: Tables):
    return m.segment_metrics(t.forecasts, "store_nbr")


@check("met5_residuals", """
SELECT date, store_nbr, family, sales - forecast_ensemble AS residual, ABS(sales - forecast_ensemble) AS abs_residual,
       CASE WHEN sales > 0 THEN (sales - forecast_ensemble) / sales ELSE 0 END AS pct_error FROM forecasts""",
       {"residual": 6, "abs_residual": 6, "pct_error": 6}, ("forecasts",))
def _(t: Tables):
    return m.residual_columns(t.forecasts, "sales", "forecast_ensemble").select(*KEYS, "residual", "abs_residual", "pct_error")


@check("lim8_ranked_segments", "SELECT segment, rmse, row_number() OVER (ORDER BY rmse, segment) AS place FROM segment_metrics", {"rmse": 6}, ("segment_metrics",))
def _(t: Tables):
    segments = m.segment_metrics(t.forecasts, "store_nbr").select("segment", "rmse")
    return with_global_position(segments, ["rmse", "segment"], "place").withColumn("place", F.col("place") + 1)


@check("lim9_best_and_worst", """
SELECT * FROM (SELECT segment, rmse, 'best' AS side FROM segment_metrics ORDER BY rmse, segment LIMIT 3) b
UNION ALL SELECT * FROM (SELECT segment, rmse, 'worst' AS side FROM segment_metrics ORDER BY rmse DESC, segment DESC LIMIT 3) w""", {"rmse": 6}, ("segment_metrics",))
def _(t: Tables):
    return m.best_and_worst(m.segment_metrics(t.forecasts, "store_nbr")).select("segment", "rmse", "side")


@check("lim11_uniform_sample", "SELECT LEAST(COUNT(*), 2000) AS n_rows, LEAST(COUNT(*), 2000) AS n_distinct FROM forecasts", views=("forecasts",))
def _(t: Tables):
    sample = dg.uniform_sample(t.forecasts.select(*KEYS, "sales"), KEYS, 2000)
    return sample.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*KEYS).alias("n_distinct"))


@check("agg20_error_by_magnitude", """
WITH d AS (SELECT sales AS actual, ABS(sales - forecast_ensemble) AS error FROM forecasts WHERE sales > 0),
q AS (SELECT list_sort(list_distinct(quantile_cont(actual, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e, COUNT(*) AS n FROM d),
b AS (SELECT d.*, q.e, CAST(len(list_filter(e[2:len(e)-1], lambda x: x < actual)) AS INT) AS bin FROM d, q)
SELECT bin, e[bin + 1] AS lower_edge, e[bin + 2] AS upper_edge, COUNT(*) AS n, AVG(actual) AS avg_actual, AVG(error) AS mean_error,
       quantile_cont(error, 0.5) AS median_error, STDDEV_SAMP(error) AS std_error, AVG(error) / AVG(actual) AS rel_error
FROM b GROUP BY bin, e""", {c: 6 for c in ("lower_edge", "upper_edge", "avg_actual", "mean_error", "median_error", "std_error", "rel_error")}, ("forecasts",))
def _(t: Tables):
    return dg.error_by_magnitude(stage(t.forecasts, "forecasts"))


@check("agg21_residual_histogram", """
WITH r AS (SELECT round(sales - forecast_ensemble, 9) AS r FROM forecasts),
s AS (SELECT MIN(r) AS lo, MAX(r) AS hi, AVG(r) AS mean FROM r)
SELECT CAST(LEAST(floor((r - lo) / ((hi - lo) / 100)), 99) AS INT) AS bin, COUNT(*) AS n, lo + (hi - lo) / 100 * CAST(LEAST(floor((r - lo) / ((hi - lo) / 100)), 99) AS INT) AS lower_edge,
       lo + (hi - lo) / 100 * (CAST(LEAST(floor((r - lo) / ((hi - lo) / 100)), 99) AS INT) + 1) AS upper_edge, mean AS mean_residual
FROM r, s GROUP BY ALL""", {"lower_edge": 6, "upper_edge": 6, "mean_residual": 6}, ("forecasts",))
def _(t: Tables):
    return dg.residual_histogram(t.forecasts, F.round(F.col("sales") - F.col("forecast_ensemble"), 9))


VIEWS["bias_by_date"] = ("SELECT date, AVG(sales - forecast_ensemble) AS residual FROM forecasts GROUP BY date", ("forecasts",))


@check("agg22_daily_bias", "SELECT * FROM bias_by_date", {"residual": 6}, ("bias_by_date",))
def _(t: Tables):
    return dg.daily_bias(t.forecasts)


@check("win9_rolling_bias", "SELECT date, residual, AVG(residual) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_bias FROM bias_by_date", {"residual": 6, "rolling_bias": 6}, ("bias_by_date",))
def _(t: Tables):
    return dg.rolling_bias(dg.daily_bias(t.forecasts))


def _report_sql() -> str:
    lines = ["'FORECAST EVALUATION REPORT: Ensemble'"]
    for text, metric, factor in dg.REPORT_LINES:
        lines.append(f"'{text}'" if metric is None else f"printf('{text}', {metric} * {factor})")
        if metric == "bias_pct":
            lines.append("'  Direction:           ' || CASE WHEN mean_bias > 0 THEN 'Over-forecasting' ELSE 'Under-forecasting' END")
    return "SELECT concat_ws(chr(10), " + ", ".join(lines) + ") AS report FROM evaluation"


@check("scl23_evaluation_report", _report_sql(), views=("evaluation",))
def _(t: Tables):
    return dg.evaluation_report(m.evaluate(stage(t.forecasts, "forecasts")), "Ensemble")
