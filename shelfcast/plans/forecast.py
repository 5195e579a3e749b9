"""Features -> trained models -> forecast table, with what each model adds and a version that holds it all."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import ensemble as ens
from shelfcast.operators.learners import BoostedTrees, RandomForest, TrainedForecaster, split_three_ways
from shelfcast.operators.model_store import train_once
from shelfcast.operators.registry import register_version
from shelfcast.operators.seasonal import SeasonalForecaster, TrainedSeasonal
from shelfcast.plans.ensemble import EnsembleModel, build_ensemble
from shelfcast.sources.storage import model_folder, stage

LEARNERS = {"xgboost": BoostedTrees(), "rf": RandomForest(), "prophet": SeasonalForecaster()}
KEYS = ("date", "store_nbr", "family")


@dataclass(frozen=True)
class ForecastRun:
    forecasts: DataFrame
    ensemble: EnsembleModel
    models: dict[str, TrainedForecaster | TrainedSeasonal]
    contributions: DataFrame
    version: str | None


def run_forecasts(
    features: DataFrame,
    names: list[str],
    learners: Mapping[str, BoostedTrees | RandomForest | SeasonalForecaster] = LEARNERS,
    stop_days: int = 180,
    holdout_days: int = 180,
    holidays: DataFrame | None = None,
    method: str = "inverse_error_weighted",
    target: str = "sales",
    registry: str | None = None,
) -> ForecastRun:
    """Train the learners on the early days of a stored feature table and forecast the last `holdout_days`.

    The `stop_days` before those stop the boosting and weigh the models; the forecast days are seen by
    neither. The forecast table has the keys, the target, forecast_<name> for each learner,
    forecast_ensemble, forecast_lower and forecast_upper. Models are trained once for the rows they see.
    With `registry` the run becomes a version with its models, metrics and parameters. Rows of the stop days
    without a target take no part in weighing.
    """
    spark = features.sparkSession
    train, stop, ahead = split_three_ways(features, stop_days, holdout_days)
    models: dict[str, TrainedForecaster | TrainedSeasonal] = {}
    for name, learner in learners.items():
        if isinstance(learner, SeasonalForecaster):
            models[name] = learner.train(train, stop, [], target, holidays)
        else:
            models[name] = train_once(model_folder(spark), learner, train, stop, names, target)
    columns = {name: f"forecast_{name}" for name in learners}

    def scored(rows: DataFrame, name: str) -> DataFrame:
        out = rows
        for model, column in columns.items():
            out = models[model].predict(out, column).drop("fitted")
        return stage(out.select(*KEYS, target, *columns.values()), name)

    validation = scored(stop.where(F.col(target).isNotNull()), "validation_forecasts")
    ensemble, blended = build_ensemble(validation, scored(ahead, "model_forecasts"), columns, method, target)
    forecasts = blended.select(*KEYS, target, *columns.values(), "forecast_ensemble", "forecast_lower", "forecast_upper")
    quality = {n: m.metrics["validation"] for n, m in models.items()}
    version = None
    if registry is not None:
        metrics = {**{n: {k: v for k, v in q.items() if v is not None} for n, q in quality.items()}, "ensemble": ensemble.metrics}
        about = {"method": method, "learners": {n: repr(x) for n, x in learners.items()}, "features": names, "stop_days": stop_days, "holdout_days": holdout_days}
        version = register_version(spark, registry, metrics, f"{method} of {', '.join(learners)}", models, about)
    return ForecastRun(forecasts, ensemble, models, contributions(spark, ensemble, models), version)


def contributions(spark: SparkSession, ensemble: EnsembleModel, models: Mapping[str, TrainedForecaster | TrainedSeasonal], top: int = 5) -> DataFrame:
    """One row per model: weight, its own rmse and mape, training_time_s and, for trees, its `top` features."""
    trees = {n: m for n, m in models.items() if isinstance(m, TrainedForecaster)}
    scores = {n: m.metrics["validation"] for n, m in models.items()}
    rows = [(n, scores[n]["rmse"], scores[n]["mape"], m.training_seconds) for n, m in models.items()]
    metrics = spark.createDataFrame(rows, "model string, rmse double, mape double, training_time_s double")
    weights = spark.createDataFrame([(n, float(ensemble.weights.get(n, 0.0))) for n in models], "model string, weight double")
    best = [(n, r["feature"], r["importance"]) for n, m in trees.items() for r in m.importance().collect()]  # one row per feature
    importances = spark.createDataFrame(best, "model string, feature string, importance double")
    return ens.contribution_table(weights, metrics, importances, top)
