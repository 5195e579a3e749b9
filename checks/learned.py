"""Learned forecasters and the version table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import VIEWS, Tables, check
from shelfcast.operators import learners as ln
from shelfcast.operators import registry as rg
from shelfcast.operators import seasonal as se
from shelfcast.operators.etl import clean_sales, effective_holidays
from shelfcast.operators.model_store import train_once
from shelfcast.plans.features import build_features
from shelfcast.plans.forecast import run_forecasts
from shelfcast.sources.storage import model_folder, new_path, stage

KEYS = ["date", "store_nbr", "family"]
HOLDOUT_DAYS = 180
SEED_OF = {"xgboost": ln.BoostedTrees(), "rf": ln.RandomForest()}
STOP_DAYS = 180  # days before the held-out ones, on which boosting decides when to stop
# is_zero_sales is made from the row's own sales
LEFT_OUT = {"date", "family", "sales", "is_zero_sales", "city", "state", "store_type", "holiday_type", "locale"}
FEATURE_NAMES = (
    "city_encoded cluster day_of_week days_since_holiday days_to_holiday has_promotion holiday_proximity is_holiday "
    "is_holiday_eve is_holiday_week is_payday is_post_holiday is_weekend log_onpromotion log_transactions month "
    "oil_price oil_price_change_7 oil_price_lag_7 oil_price_level oil_price_ma_14 oil_price_volatility_14 onpromotion "
    "promo_vs_store_avg sales_lag_14 sales_lag_28 sales_lag_7 sales_rolling_mean_28 sales_rolling_mean_7 state_encoded "
    "store_nbr store_total_promotions store_type_encoded transactions txn_vs_store_avg year"
).split()


def _training(t: Tables):
    """All features of the whole fact, split three ways, and the names of the numeric ones."""
    built = stage(build_features(stage(t.fact, "fact")), "features")
    numeric = sorted(c for c, kind in built.dtypes if c not in LEFT_OUT and kind not in ("string", "date"))
    return (*ln.split_three_ways(built, STOP_DAYS, HOLDOUT_DAYS), numeric)


def _model(t: Tables, kind: str):
    """The model of this kind, trained once for all queries, and the days it has not seen."""
    train, stop, held_out, features = _training(t)
    return train_once(model_folder(t.spark), SEED_OF[kind], train, stop, features), train, held_out


def _clean_split(t: Tables):
    return ln.split_by_date(stage(clean_sales(t.sales), "sales"), HOLDOUT_DAYS)


VIEWS["held_out"] = ("SELECT * FROM clean WHERE date > (SELECT max(date) FROM clean) - 180", ("clean",))
_JUDGED = "SELECT date, store_nbr, family, sales, true AS usable, true AS beats_mean FROM held_out"


def _judged(train, scored, forecast: str, slack: float = 1.0):
    """The scored rows with the tests that a forecast must pass: it is there and not negative, and over
    all rows its error is below that of the training mean (times `slack`). SQL knows the rows and that
    the tests hold; what the trees predict it cannot know."""
    scored = stage(scored, "scored")
    mean = train.agg(F.avg("sales")).scalar()
    gap, naive = F.col("sales") - F.col(forecast), F.col("sales") - F.col("_mean")
    better = scored.withColumn("_mean", mean).agg(F.avg(gap * gap) < slack * slack * F.avg(naive * naive)).scalar()
    return scored.select(*KEYS, "sales", F.coalesce(F.col(forecast) >= 0, F.lit(False)).alias("usable"), better.alias("beats_mean"))


@check("mod1_boosted_trees", _JUDGED.replace("true AS beats_mean", "true AS beats_mean, true AS many_trees, true AS patient"), views=("held_out",))
def _(t: Tables):
    """many_trees: the model has more than one tree; patient: it ends where the error is least, and was
    grown until `patience` more trees had not lowered it, or to the full number."""
    model, train, held_out = _model(t, "xgboost")
    learner, curve = SEED_OF["xgboost"], model.curve
    ended = len(curve) > learner.trees or len(curve) - 1 - model.trees >= learner.patience
    patient = ended and curve[model.trees] == min(curve)
    judged = _judged(train, model.predict(held_out, "forecast_xgboost"), "forecast_xgboost")
    return judged.withColumns({"many_trees": F.lit(model.trees > 1), "patient": F.lit(patient)})


@check("mod1_error_by_trees")
def _(t: Tables):
    """The squared error on the stop days for every number of trees, and which number the model has. SQL
    cannot grow trees; tests hold the curve against the model's own prefixes."""
    model, _, _ = _model(t, "xgboost")
    rows = [(i, float(e), i == model.trees) for i, e in enumerate(model.curve)]
    return t.spark.createDataFrame(rows, "trees int, squared_error double, kept boolean")


@check("mod2_random_forest", _JUDGED, views=("held_out",))
def _(t: Tables):
    model, train, held_out = _model(t, "rf")
    return _judged(train, model.predict(held_out, "forecast_rf"), "forecast_rf")


_HAS_SERIES = "EXISTS (SELECT 1 FROM clean c WHERE c.store_nbr IS NOT DISTINCT FROM h.store_nbr AND c.family IS NOT DISTINCT FROM h.family AND c.date <= (SELECT max(date) FROM clean) - 180)"


def _seasonal(t: Tables):
    train, held_out = _clean_split(t)
    days = stage(effective_holidays(t.holidays).select("date"), "holidays")
    return se.SeasonalForecaster().train(train, held_out, [], holidays=days), train, held_out


@check("mod3_seasonal_series", f"SELECT date, store_nbr, family, sales, true AS usable, true AS beats_mean, {_HAS_SERIES} AS fitted FROM held_out h", views=("held_out", "clean"))
def _(t: Tables):
    """The series of these tables are noise around a level, so no seasonal form gains on the mean: the
    test is that the fit loses less than 2 % to it. `fitted` is true for the rows of every series that has
    training rows; the others get the mean."""
    model, train, held_out = _seasonal(t)
    scored = stage(model.predict(held_out.select(*KEYS, "sales"), "point"), "points")
    judged = _judged(train, scored, "point", 1.02)
    return judged.join(scored.select(*KEYS, "fitted"), KEYS)


@check("mod3_interval_coverage", "SELECT count(*) AS n, true AS within_three_points, true AS wider_later FROM (SELECT date FROM clean WHERE date > (SELECT max(date) FROM clean) - 180 GROUP BY date) d", views=("clean",))
def _(t: Tables):
    """Of the held-out days of the daily total, the share inside the interval of 95 %, and whether the last
    day's interval is at least as wide as the first's."""
    train, held_out = _clean_split(t)
    days = effective_holidays(t.holidays).select("date")
    model = stage(se.fit_seasonal(se.daily_totals(train), [], days), "total_model")
    rows = se.daily_totals(held_out).join(se.forecast_dates(model, held_out, days), "date")
    inside = F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double"))
    width = F.col("yhat_upper") - F.col("yhat_lower")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(inside - 0.95) <= 0.03).alias("within_three_points"),
        (F.max_by(width, "date") >= F.min_by(width, "date")).alias("wider_later"),
    )


@check("mod5_seasonal_save_load", "SELECT date, store_nbr, family, true AS same FROM held_out", views=("held_out",))
def _(t: Tables):
    model, _, held_out = _seasonal(t)
    folder = new_path(t.spark, "seasonal_model")
    model.save(folder)
    both = se.TrainedSeasonal.load(folder).predict(model.predict(held_out.select(*KEYS), "before").drop("fitted"), "after")
    return both.select(*KEYS, F.col("before").eqNullSafe(F.col("after")).alias("same"))


@check("mod4_seasonal_features", "SELECT date, store_nbr, family, true AS complete FROM clean", views=("clean",))
def _(t: Tables):
    train, _ = _clean_split(t)
    model = se.fit_seasonal(se.daily_totals(train), [])
    rows = se.seasonal_features(model, clean_sales(t.sales).select(*KEYS))
    parts = F.col("prophet_trend") * (1 + F.col("prophet_yearly") + F.col("prophet_weekly"))
    return rows.select(*KEYS, (F.abs(parts - F.col("prophet_yhat")) < 1e-6 * F.abs(F.col("prophet_yhat")) + 1e-6).alias("complete"))


VIEWS["by_date"] = ("SELECT date, SUM(forecast_prophet) AS yhat, SUM(forecast_rf) AS trend_part, AVG(forecast_prophet) AS yearly_part, AVG(forecast_rf) AS weekly_part FROM forecasts GROUP BY date", ("forecasts",))


def _by_date(t: Tables):
    """A forecast by date that SQL can build too: the daily totals of a model column."""
    return t.forecasts.groupBy("date").agg(
        F.sum("forecast_prophet").alias("yhat"), F.sum("forecast_rf").alias("trend_part"),
        F.avg("forecast_prophet").alias("yearly_part"), F.avg("forecast_rf").alias("weekly_part"),
    )


@check("jn9_validation_total", """
WITH p AS (SELECT a.y AS a, GREATEST(b.yhat, 0) AS p FROM (SELECT date, SUM(sales) AS y FROM held_out GROUP BY date) a JOIN by_date b USING (date))
SELECT AVG(ABS(a-p)) AS mae, SQRT(AVG((a-p)*(a-p))) AS rmse, COALESCE(AVG(CASE WHEN a > 0 THEN ABS(a-p)/a END), 'Infinity'::DOUBLE)*100 AS mape,
       AVG(2*ABS(a-p) / CASE WHEN ABS(a)+ABS(p) = 0 THEN 1 ELSE ABS(a)+ABS(p) END)*100 AS smape,
       1 - SUM((a-p)*(a-p)) / (COUNT(*)*VAR_POP(a)) AS r2, SQRT(AVG((ln(1+p)-ln(1+a))*(ln(1+p)-ln(1+a)))) AS rmsle FROM p""",
       {c: 4 for c in ("mae", "rmse", "mape", "smape", "r2")} | {"rmsle": 6}, ("held_out", "by_date"))
def _(t: Tables):
    _, held_out = _clean_split(t)
    return se.validate_dates(_by_date(t), held_out)


@check("jn10_rows_with_date_forecast", "SELECT c.date, store_nbr, family, GREATEST(yhat, 0) AS prophet_total_forecast FROM clean c LEFT JOIN by_date b USING (date)", {"prophet_total_forecast": 5}, ("clean", "by_date"))
def _(t: Tables):
    return se.predict_rows(_by_date(t), clean_sales(t.sales).select(*KEYS))


@check("jn11_rows_with_components", """
SELECT c.date, store_nbr, family, sales, COALESCE(yhat, 0) AS prophet_yhat, COALESCE(trend_part, 0) AS prophet_trend, COALESCE(yearly_part, 0) AS prophet_yearly, COALESCE(weekly_part, 0) AS prophet_weekly
FROM clean c LEFT JOIN by_date b USING (date)""", {c: 5 for c in ("prophet_yhat", "prophet_trend", "prophet_yearly", "prophet_weekly")}, ("clean", "by_date"))
def _(t: Tables):
    return se.with_date_parts(_by_date(t), clean_sales(t.sales).select(*KEYS, "sales"))


@check("mod5_train_save_load_predict", "SELECT date, store_nbr, family, true AS same FROM held_out", views=("held_out",))
def _(t: Tables):
    """A saved and loaded model predicts what the model predicts, on every row."""
    model, _, held_out = _model(t, "rf")
    folder = new_path(t.spark, "model")
    model.save(folder)
    both = ln.TrainedForecaster.load(folder).predict(model.predict(held_out, "before"), "after")
    return both.select(*KEYS, F.col("before").eqNullSafe(F.col("after")).alias("same"))


_NAMED = "(VALUES " + ", ".join(f"('{c}')" for c in FEATURE_NAMES) + ") AS f(feature)"


def _run(t: Tables):
    built = stage(build_features(stage(t.fact, "fact")), "features")
    numeric = sorted(c for c, kind in built.dtypes if c not in LEFT_OUT and kind not in ("string", "date"))
    days = stage(effective_holidays(t.holidays).select("date"), "holidays")
    # mod1 and mod2 train the full models; the plan is the same with smaller ones
    learners = {"xgboost": ln.BoostedTrees(trees=30, depth=6), "rf": ln.RandomForest(trees=40, depth=10), "prophet": se.SeasonalForecaster()}
    return run_forecasts(built, numeric, learners, STOP_DAYS, HOLDOUT_DAYS, days, registry=new_path(t.spark, "registry"))


@check("ens13_features_to_forecasts", "SELECT date, store_nbr, family, sales, true AS complete, true AS blended, true AS bounded FROM held_out", views=("held_out",))
def _(t: Tables):
    """From features over trained models to the forecast table: every forecast is there and not negative, the
    ensemble lies between the models, and the bounds around it."""
    rows = _run(t).forecasts
    models = [f"forecast_{n}" for n in ("xgboost", "rf", "prophet")]
    complete = F.coalesce(F.least(*models, "forecast_ensemble") >= 0, F.lit(False))
    for c in models:
        complete = complete & F.col(c).isNotNull()
    blended = F.col("forecast_ensemble").between(F.least(*models) - 1e-9, F.greatest(*models) + 1e-9)
    bounded = (F.col("forecast_lower") <= F.col("forecast_ensemble")) & (F.col("forecast_ensemble") <= F.col("forecast_upper"))
    return rows.select(*KEYS, "sales", complete.alias("complete"), blended.alias("blended"), bounded.alias("bounded"))


@check("ens11_trained_contribution", """
SELECT model, true AS weighed, true AS timed, n_features FROM (VALUES ('xgboost', 5), ('rf', 5), ('prophet', NULL)) AS m(model, n_features)""")
def _(t: Tables):
    table = _run(t).contributions
    total = table.agg(F.sum("weight")).scalar()
    weighed = F.col("weight").between(0, 1) & (F.abs(total - 1) < 1e-9) & (F.col("standalone_rmse") > 0)
    return table.select("model", weighed.alias("weighed"), (F.col("training_time_s") > 0).alias("timed"), F.size("top_features").alias("n_features"))


@check("mod6_feature_importance", f"SELECT feature, true AS share, true AS sums_to_one FROM {_NAMED}")
def _(t: Tables):
    rows = _model(t, "rf")[0].importance()
    total = rows.agg(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    return rows.select("feature", F.col("importance").between(0, 1).alias("share"), total.alias("sums_to_one"))


def _ordered(rows):
    """One row per feature, so one task may number them."""
    w = Window.orderBy(F.monotonically_increasing_id())
    return rows.coalesce(1).withColumn("place", F.row_number().over(w)).withColumn("falls", F.coalesce(F.col("importance") <= F.lag("importance").over(w), F.lit(True))).select("place", "falls")


@check("lim10_top_features", "SELECT CAST(range AS INT) AS place, true AS falls FROM range(1, 21)")
def _(t: Tables):
    return _ordered(_model(t, "rf")[0].top_features(20))


@check("lim10_all_features", f"SELECT CAST(range AS INT) AS place, true AS falls FROM range(1, {len(FEATURE_NAMES)} + 1)")
def _(t: Tables):
    return _ordered(_model(t, "rf")[0].top_features(None))


@check("agg1_daily_total", "SELECT date, SUM(sales) AS y FROM clean GROUP BY date", views=("clean",))
def _(t: Tables):
    return se.daily_totals(clean_sales(t.sales))


@check("agg2_series_total", "SELECT store_nbr, family, SUM(sales) AS total FROM clean GROUP BY 1, 2", views=("clean",))
def _(t: Tables):
    return se.series_totals(clean_sales(t.sales))


@check("agg3_series_daily", """
SELECT store_nbr, family, date, SUM(sales) AS y FROM clean GROUP BY 1, 2, 3""", views=("clean",))
def _(t: Tables):
    return se.daily_by_series(clean_sales(t.sales))


@check("lim2_top_series", "SELECT store_nbr, family, SUM(sales) AS total FROM clean GROUP BY 1, 2 ORDER BY total DESC, store_nbr, family LIMIT 10", views=("clean",))
def _(t: Tables):
    return se.top_series(clean_sales(t.sales))


@check("set1_distinct_dates", "SELECT DISTINCT date FROM sales", views=("sales",))
def _(t: Tables):
    return t.sales.select("date").distinct()


_ROWS = " UNION ALL ".join(
    f"SELECT CAST(year(date) AS INT) AS y, '{m}' AS model, '{k}' AS metric, round({e}, 6) AS value FROM forecasts GROUP BY 1"
    for m, c in (("ensemble", "forecast_ensemble"), ("rf", "forecast_rf"), ("xgboost", "forecast_xgboost"))
    for k, e in (("mae", f"AVG(ABS(sales - {c}))"), ("rmse", f"SQRT(AVG((sales - {c}) * (sales - {c})))"))
)
VIEWS["versions"] = (f"SELECT CAST(nr AS INT) AS version_nr, 'v' || nr AS version, model, metric, value FROM (SELECT *, dense_rank() OVER (ORDER BY y) AS nr FROM ({_ROWS}) r) v", ("forecasts",))


def _registry_path(t: Tables) -> str:
    """One version per year, registered from the metrics of the model columns in that year."""
    models = {"ensemble": "forecast_ensemble", "rf": "forecast_rf", "xgboost": "forecast_xgboost"}
    aggs = []
    for m, c in models.items():
        error = F.col("sales") - F.col(c)
        aggs += [F.avg(F.abs(error)).alias(f"{m}.mae"), F.sqrt(F.avg(error * error)).alias(f"{m}.rmse")]
    yearly = t.forecasts.groupBy(F.year("date").alias("y")).agg(*aggs)
    path = new_path(t.spark, "registry")
    found = {r["y"]: r.asDict() for r in yearly.collect()}  # one row per year
    for y in sorted(found):
        metrics = {m: {k: found[y][f"{m}.{k}"] for k in ("mae", "rmse")} for m in models}
        rg.register_version(t.spark, path, metrics, f"year {y}", parameters={"year": y})
    return path


def _registry(t: Tables):
    return rg.read_registry(t.spark, _registry_path(t))


@check("mod7_register_version", "SELECT version_nr, version, model, metric, value FROM versions", {"value": 6}, ("versions",))
def _(t: Tables):
    return _registry(t).select("version_nr", "version", "model", "metric", "value")


@check("mod7_parameters", """
SELECT version_nr, version, sha256('{"year": ' || y || '}') AS parameters_digest, 'year ' || y AS description
FROM (SELECT DISTINCT CAST(year(date) AS INT) AS y, CAST(dense_rank() OVER (ORDER BY year(date)) AS INT) AS version_nr FROM forecasts) v, LATERAL (SELECT 'v' || version_nr AS version) x""", views=("forecasts",))
def _(t: Tables):
    return _registry(t).select("version_nr", "version", "parameters_digest", "description").distinct()


@check("dom15_load_version", """
SELECT 'best' AS asked, version, model, metric, value FROM versions WHERE version_nr = (SELECT version_nr FROM versions WHERE model = 'ensemble' AND metric = 'rmse' ORDER BY value, version_nr LIMIT 1)
UNION ALL SELECT 'latest', version, model, metric, value FROM versions WHERE version_nr = (SELECT max(version_nr) FROM versions)
UNION ALL SELECT 'v1', version, model, metric, value FROM versions WHERE version_nr = 1""", {"value": 6}, ("versions",))
def _(t: Tables):
    path = _registry_path(t)
    asked = {"best": rg.load_version(t.spark, path, best=True), "latest": rg.load_version(t.spark, path), "v1": rg.load_version(t.spark, path, "v1")}
    parts = [v.metrics.select(F.lit(k).alias("asked"), F.lit(v.version).alias("version"), "model", "metric", "value") for k, v in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("set5_compare_versions", """
SELECT version_nr, version, MAX(CASE WHEN model = 'ensemble' AND metric = 'mae' THEN value END) AS ensemble_mae, MAX(CASE WHEN model = 'ensemble' AND metric = 'rmse' THEN value END) AS ensemble_rmse,
       MAX(CASE WHEN model = 'rf' AND metric = 'mae' THEN value END) AS rf_mae, MAX(CASE WHEN model = 'rf' AND metric = 'rmse' THEN value END) AS rf_rmse,
       MAX(CASE WHEN model = 'xgboost' AND metric = 'mae' THEN value END) AS xgboost_mae, MAX(CASE WHEN model = 'xgboost' AND metric = 'rmse' THEN value END) AS xgboost_rmse,
       COUNT(DISTINCT model) AS n_models
FROM versions GROUP BY 1, 2""", {c: 6 for c in ("ensemble_mae", "ensemble_rmse", "rf_mae", "rf_rmse", "xgboost_mae", "xgboost_rmse")}, ("versions",))
def _(t: Tables):
    return rg.ranked_versions(_registry(t)).drop("description")


@check("dom15_best_and_latest", """
SELECT (SELECT version FROM versions WHERE model = 'ensemble' AND metric = 'rmse' ORDER BY value, version_nr LIMIT 1) AS best_version,
       (SELECT version FROM versions ORDER BY version_nr DESC LIMIT 1) AS latest_version""", views=("versions",))
def _(t: Tables):
    return rg.best_and_latest(_registry(t))
