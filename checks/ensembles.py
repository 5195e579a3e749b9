"""Weights, combination, intervals, comparison and summary of ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from checks.evaluation import FAMILY, family_sql
from shelfcast.operators import ensemble as ens
from shelfcast.operators import metrics as m
from shelfcast.operators.stacking import fit_blend, fold_blocks, optimality
from shelfcast.plans.ensemble import EnsembleModel, build_ensemble, fit_ensemble
from shelfcast.sources import sinks
from shelfcast.sources.storage import new_path, stage

KEYS = ["date", "store_nbr", "family"]
MODELS = {"prophet": "forecast_prophet", "rf": "forecast_rf", "xgboost": "forecast_xgboost"}


def _rmse(p: str) -> str:
    return f"1 / (SQRT(AVG((sales - {p}) * (sales - {p}))) + 1e-10::DOUBLE)"


_INV = ", ".join(f"{_rmse(c)} AS {n}" for n, c in MODELS.items())
VIEWS["w"] = (f"SELECT prophet / (prophet + rf + xgboost) AS prophet, rf / (prophet + rf + xgboost) AS rf, xgboost / (prophet + rf + xgboost) AS xgboost FROM (SELECT {_INV} FROM forecasts) i", ("forecasts",))
VIEWS["sw"] = (f"""
SELECT segment, CASE WHEN n < 10 THEN 1.0::DOUBLE / 3 ELSE prophet / (prophet + rf + xgboost) END AS prophet,
       CASE WHEN n < 10 THEN 1.0::DOUBLE / 3 ELSE rf / (prophet + rf + xgboost) END AS rf, CASE WHEN n < 10 THEN 1.0::DOUBLE / 3 ELSE xgboost / (prophet + rf + xgboost) END AS xgboost
FROM (SELECT store_nbr AS segment, COUNT(*) AS n, {_INV} FROM forecasts GROUP BY store_nbr) i""", ("forecasts",))
_MIX = "w.prophet * forecast_prophet + w.rf * forecast_rf + w.xgboost * forecast_xgboost"
VIEWS["combined"] = (f"SELECT f.*, {_MIX} AS combined FROM forecasts f, w", ("forecasts", "w"))
_MEAN = "((forecast_prophet + forecast_rf + forecast_xgboost) / 3)"
_STD = f"SQRT(((forecast_prophet - {_MEAN}) * (forecast_prophet - {_MEAN}) + (forecast_rf - {_MEAN}) * (forecast_rf - {_MEAN}) + (forecast_xgboost - {_MEAN}) * (forecast_xgboost - {_MEAN})) / 3)"
VIEWS["bounded"] = (f"""
SELECT c.*, GREATEST({_STD}, 0.5 * v.rmse) AS u FROM combined c, (SELECT SQRT(AVG((sales - combined) * (sales - combined))) AS rmse FROM combined) v""", ("combined",))
VIEWS["intervals"] = ("SELECT date, store_nbr, family, GREATEST(combined, 0) AS point, GREATEST(combined - 1.96 * u, 0) AS lower, combined + 1.96 * u AS upper FROM bounded", ("bounded",))
_MODEL_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS model, (SELECT {n} FROM w) AS weight, {family_sql('sales', c)} FROM forecasts" for n, c in MODELS.items())
VIEWS["model_comparison"] = (f"""{_MODEL_ROWS}
UNION ALL SELECT 'ENSEMBLE (inverse_error_weighted)', 1.0::DOUBLE, {family_sql('sales', 'combined')} FROM combined""", ("combined", "w"))
POINT = {"point": 6}
INTERVAL = {"point": 6, "lower": 6, "upper": 6}


def _weights(df):
    return ens.inverse_error_weights(df, "sales", MODELS).scalar()


@check("ens1_simple_average", "SELECT date, store_nbr, family, forecast_prophet / 3 + forecast_rf / 3 + forecast_xgboost / 3 AS point FROM forecasts", POINT, ("forecasts",))
def _(t: Tables):
    return t.forecasts.select(*KEYS, ens.combine(MODELS, ens.equal_weights(MODELS)).alias("point"))


@check("ens1_weighted_average", "SELECT date, store_nbr, family, 0.2::DOUBLE * forecast_prophet + 0.3::DOUBLE * forecast_rf + 0.5::DOUBLE * forecast_xgboost AS point FROM forecasts", POINT, ("forecasts",))
def _(t: Tables):
    return t.forecasts.select(*KEYS, ens.combine(MODELS, {"prophet": 0.2, "rf": 0.3, "xgboost": 0.5}).alias("point"))


@check("ens2_inverse_error_weights", "SELECT 'prophet' AS model, prophet AS weight FROM w UNION ALL SELECT 'rf', rf FROM w UNION ALL SELECT 'xgboost', xgboost FROM w", {"weight": 8}, ("w",))
def _(t: Tables):
    return ens.weights_long(ens.inverse_error_weights(t.forecasts, "sales", MODELS))


_STACKED = "SELECT date, store_nbr, family, true AS usable, true AS best_fit FROM forecasts"


def _stacked(t: Tables, regularized: bool):
    """Every row with the tests that its blend must pass: the forecast is usable, and the fit meets the
    conditions of the best non-negative one. SQL knows the keys and that the tests hold."""
    f = stage(t.forecasts, "forecasts")
    blend = fit_blend(f, "sales", MODELS, regularized=regularized)
    met = (F.col("coefficient") >= 0) & F.when(F.col("coefficient") > 0, F.abs("slope") < 1e-6).otherwise(F.col("slope") < 1e-6)
    best = optimality(f, "sales", MODELS, blend).agg(F.bool_and(met)).scalar()
    point = ens.floor_at(ens.combine_blend(MODELS, blend), 0.0)
    return f.select(*KEYS, F.coalesce(point >= 0, F.lit(False)).alias("usable"), best.alias("best_fit"))


@check("ens3_stacking_ridge", _STACKED, views=("forecasts",))
def _(t: Tables):
    return _stacked(t, True)


@check("ens4_stacking_linear", _STACKED, views=("forecasts",))
def _(t: Tables):
    return _stacked(t, False)


@check("win15_time_folds", """
SELECT date, store_nbr, family, pos, CAST(CASE WHEN pos < n - 3 * (n // 4) THEN 0 ELSE (pos - (n - 3 * (n // 4))) // (n // 4) + 1 END AS INT) AS fold
FROM (SELECT date, store_nbr, family, row_number() OVER (ORDER BY date, store_nbr, family) - 1 AS pos, COUNT(*) OVER () AS n FROM forecasts) x""", views=("forecasts",))
def _(t: Tables):
    return fold_blocks(t.forecasts.select(*KEYS), tuple(KEYS))


@check("ens5_segment_weights", "SELECT segment, 'prophet' AS model, prophet AS weight FROM sw UNION ALL SELECT segment, 'rf', rf FROM sw UNION ALL SELECT segment, 'xgboost', xgboost FROM sw", {"weight": 8}, ("sw",))
def _(t: Tables):
    return ens.weights_long(ens.segment_weights(t.forecasts, "sales", MODELS, "store_nbr")).drop("enough_rows")


@check("ens6_combine_weighted", "SELECT date, store_nbr, family, combined AS point FROM combined", POINT, ("combined",))
def _(t: Tables):
    f = t.forecasts
    return f.select(*KEYS, ens.combine(MODELS, _weights(f)).alias("point"))


@check("jn13_segment_weight_lookup", """
SELECT date, store_nbr, family, COALESCE(s.prophet, w.prophet) * forecast_prophet + COALESCE(s.rf, w.rf) * forecast_rf + COALESCE(s.xgboost, w.xgboost) * forecast_xgboost AS point
FROM forecasts f LEFT JOIN sw s ON f.store_nbr = s.segment, w""", POINT, ("forecasts", "sw", "w"))
def _(t: Tables):
    f = t.forecasts
    fitted = ens.segment_weights(f, "sales", MODELS, "store_nbr")
    joined = ens.with_segment_weights(f, fitted, _weights(f), "store_nbr")
    return joined.select(*KEYS, ens.combine(MODELS, F.col("_weights")).alias("point"))


@check("ens7_predict", "SELECT date, store_nbr, family, GREATEST(combined, 20) AS point FROM combined", POINT, ("combined",))
def _(t: Tables):
    f = t.forecasts
    return f.select(*KEYS, ens.floor_at(ens.combine(MODELS, _weights(f)), 20.0).alias("point"))


@check("ens8_spread_intervals", "SELECT * FROM intervals", INTERVAL, ("intervals",))
def _(t: Tables):
    f = t.forecasts
    point = ens.combine(MODELS, _weights(f))
    rmse = m.aggregate(f.select("sales", point.alias("c")), {"rmse": m.ensemble_metrics("sales", "c")["rmse"]}).scalar()
    low, high = ens.spread_intervals(point, MODELS, rmse)
    return f.select(*KEYS, ens.floor_at(point, 0.0).alias("point"), ens.floor_at(low, 0.0).alias("lower"), high.alias("upper"))


@check("ens9_given_intervals", f"""
SELECT date, store_nbr, family, GREATEST(w.prophet * forecast_lower + w.rf * (forecast_rf - {_STD}) + w.xgboost * (forecast_xgboost - {_STD}), 0) AS lower,
       w.prophet * forecast_upper + w.rf * (forecast_rf + {_STD}) + w.xgboost * (forecast_xgboost + {_STD}) AS upper
FROM forecasts, w""", {"lower": 6, "upper": 6}, ("forecasts", "w"))
def _(t: Tables):
    f = t.forecasts
    low, high = ens.given_intervals(MODELS, _weights(f), {"prophet": ("forecast_lower", "forecast_upper")})
    return f.select(*KEYS, ens.floor_at(low, 0.0).alias("lower"), high.alias("upper"))


COMPARISON = {**FAMILY, "weight": 8}


def _comparison(t: Tables):
    f = t.forecasts
    w = _weights(f)
    rows = f.select("sales", *MODELS.values(), ens.combine(MODELS, w).alias("combined"))
    return ens.comparison_table(rows, "sales", MODELS, "combined", "inverse_error_weighted", w)


@check("ens10_comparison_table", "SELECT * FROM model_comparison", COMPARISON, ("model_comparison",))
def _(t: Tables):
    return _comparison(t)


@check("ens10_best_model", """
SELECT (SELECT model FROM model_comparison ORDER BY rmse, model LIMIT 1) AS best_model, (SELECT model FROM model_comparison ORDER BY rmse, model LIMIT 1) LIKE 'ENSEMBLE%' AS ensemble_is_best,
       (MIN(CASE WHEN model LIKE 'ENSEMBLE%' THEN rmse END) - MIN(rmse)) / MIN(rmse) * 100 AS gap_pct FROM model_comparison""", {"gap_pct": 6}, ("model_comparison",))
def _(t: Tables):
    return ens.best_model(_comparison(t))


@check("set2_stack_methods", "SELECT model, rmse, mae FROM model_comparison", {"rmse": 6, "mae": 6}, ("model_comparison",))
def _(t: Tables):
    return _comparison(t).select("model", "rmse", "mae")


@check("ens11_contribution", "SELECT model, weight, rmse AS standalone_rmse, mape AS standalone_mape FROM model_comparison WHERE model NOT LIKE 'ENSEMBLE%'", {"weight": 8, "standalone_rmse": 6, "standalone_mape": 6}, ("model_comparison",))
def _(t: Tables):
    table = _comparison(t).where(~F.col("model").startswith("ENSEMBLE"))
    metrics = table.select("model", "rmse", "mape", F.lit(0.0).alias("training_time_s"))
    return ens.contribution_table(table.select("model", "weight"), metrics).drop("training_time_s")


@check("agg16_summary_stats", """
SELECT SUM(forecast_ensemble) AS total_forecasted_sales, AVG(forecast_ensemble) AS avg_daily_sales, quantile_cont(forecast_ensemble, 0.5) AS median_daily_sales, MAX(forecast_ensemble) AS max_daily_sales,
       MIN(forecast_ensemble) AS min_daily_sales, STDDEV_POP(forecast_ensemble) AS std_daily_sales, COUNT(*) AS forecast_count FROM forecasts""",
       {"total_forecasted_sales": 3, "avg_daily_sales": 6, "median_daily_sales": 6, "max_daily_sales": 6, "min_daily_sales": 6, "std_daily_sales": 6}, ("forecasts",))
def _(t: Tables):
    return ens.summary_stats(stage(t.forecasts, "forecasts"), "forecast_ensemble")


_WEEK = "CAST(date + CAST((7 - isodow(date)) AS INT) AS DATE)"
VIEWS["weekly"] = (f"""
WITH s AS (SELECT {_WEEK} AS period, SUM(forecast_ensemble) AS total FROM forecasts GROUP BY 1)
SELECT p.period, COALESCE(total, 0) AS total FROM (SELECT CAST(unnest(generate_series(MIN(period), MAX(period), INTERVAL 7 DAY)) AS DATE) AS period FROM s) p LEFT JOIN s USING (period)""", ("forecasts",))
VIEWS["monthly"] = ("""
WITH s AS (SELECT last_day(date) AS period, SUM(forecast_ensemble) AS total FROM forecasts GROUP BY 1)
SELECT p.period, COALESCE(total, 0) AS total FROM (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', MIN(period)), date_trunc('month', MAX(period)), INTERVAL 1 MONTH)) AS DATE)) AS period FROM s) p LEFT JOIN s USING (period)""", ("forecasts",))
VIEWS["by_store"] = ("SELECT store_nbr AS store, SUM(forecast_ensemble) AS total FROM forecasts GROUP BY 1", ("forecasts",))


@check("agg17_weekly_totals", "SELECT * FROM weekly", {"total": 4}, ("weekly",))
def _(t: Tables):
    return ens.weekly_totals(t.forecasts, "forecast_ensemble")


@check("agg18_monthly_totals", "SELECT * FROM monthly", {"total": 4}, ("monthly",))
def _(t: Tables):
    return ens.monthly_totals(t.forecasts, "forecast_ensemble")


@check("agg19_store_totals", "SELECT * FROM by_store", {"total": 4}, ("by_store",))
def _(t: Tables):
    return ens.store_totals(t.forecasts, "forecast_ensemble")


@check("lim5_top_and_bottom_stores", """
SELECT * FROM (SELECT store, total, 'top' AS side FROM by_store ORDER BY total DESC, store LIMIT 5) a
UNION ALL SELECT * FROM (SELECT store, total, 'bottom' AS side FROM by_store ORDER BY total, store LIMIT 5) b""", {"total": 4}, ("by_store",))
def _(t: Tables):
    return ens.top_and_bottom(ens.store_totals(t.forecasts, "forecast_ensemble"))


@check("ens12_forecast_summary", """
SELECT 'week' AS part, CAST(period AS VARCHAR) AS label, total FROM weekly UNION ALL SELECT 'month', CAST(period AS VARCHAR), total FROM monthly
UNION ALL SELECT * FROM (SELECT 'top', CAST(store AS VARCHAR), total FROM by_store ORDER BY total DESC, store LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'bottom', CAST(store AS VARCHAR), total FROM by_store ORDER BY total, store LIMIT 5) b
UNION ALL SELECT 'total', 'total', SUM(forecast_ensemble) FROM forecasts""", {"total": 3}, ("weekly", "monthly", "by_store"))
def _(t: Tables):
    row = ens.forecast_summary(stage(t.forecasts, "forecasts"), "forecast_ensemble", "simple_average", ens.equal_weights(MODELS))
    row = stage(row, "summary")
    parts = [("week", "weekly_forecast"), ("month", "monthly_forecast"), ("top", "top_5_stores"), ("bottom", "bottom_5_stores")]
    out = row.select(F.lit("total").alias("part"), F.lit("total").alias("label"), F.col("total_forecasted_sales").alias("total"))
    for part, column in parts:
        out = out.unionByName(row.select(F.lit(part).alias("part"), F.explode(column).alias("label", "total")))
    return out


@check("ens13_build_ensemble", "SELECT * FROM intervals", INTERVAL, ("intervals",))
def _(t: Tables):
    f = stage(t.forecasts.select(*KEYS, "sales", *MODELS.values()), "forecasts")
    _, out = build_ensemble(f, f, MODELS)
    return out.select(*KEYS, F.col("forecast_ensemble").alias("point"), F.col("forecast_lower").alias("lower"), F.col("forecast_upper").alias("upper"))


@check("snk5_comparison_csv", "SELECT * FROM model_comparison", COMPARISON, ("model_comparison",))
def _(t: Tables):
    path = sinks.write_csv(_comparison(t), new_path(t.spark, "comparison"))
    return t.spark.read.option("header", True).schema("model string, " + ", ".join(f"{c} double" for c in ens.COMPARISON_COLUMNS[1:])).csv(path)


@check("snk6_save_and_load", """
SELECT date, store_nbr, family, GREATEST(s.prophet * forecast_prophet + s.rf * forecast_rf + s.xgboost * forecast_xgboost, 0) AS point
FROM forecasts f JOIN sw s ON f.store_nbr = s.segment""", POINT, ("forecasts", "sw"))
def _(t: Tables):
    f = stage(t.forecasts.select(*KEYS, "sales", *MODELS.values()), "forecasts")
    folder = new_path(t.spark, "ensemble")
    fit_ensemble(f, MODELS, "dynamic_weighted", segment_col="store_nbr").save(folder)
    return EnsembleModel.load(t.spark, folder).predict(f, MODELS, "point").select(*KEYS, "point")
