"""Fit, apply, save and load an ensemble of model columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import ensemble as ens
from shelfcast.operators.stacking import Blend, fit_blend
from shelfcast.sources.readers import read_table_or_empty
from shelfcast.sources.sinks import write_csv, write_parquet


@dataclass(frozen=True)
class EnsembleModel:
    method: str
    weights: dict[str, float]
    metrics: dict[str, float]
    comparison: DataFrame
    blend: Blend | None = None
    segment_weights: DataFrame | None = None
    segment_col: str | None = None
    clip_predictions: bool = True
    min_prediction: float = 0.0
    confidence_level: float = 0.95

    @property
    def _floor(self) -> float | None:
        return self.min_prediction if self.clip_predictions else None

    def with_weights(self, weights: Mapping[str, float]) -> EnsembleModel:
        """Set the weights of a weighted average by hand."""
        return replace(self, weights=dict(weights))

    def _combined(self, df: DataFrame, models: ens.Models) -> tuple[DataFrame, Column, list[str]]:
        if self.blend is not None:
            return df, ens.combine_blend(models, self.blend), []
        if self.segment_weights is not None and self.segment_col in df.columns:
            joined = ens.with_segment_weights(df, self.segment_weights, self.weights, self.segment_col)
            return joined, ens.combine(models, F.col("_weights")), ["_weights"]
        return df, ens.combine(models, self.weights), []

    def predict(self, df: DataFrame, models: ens.Models, out: str = "forecast_ensemble") -> DataFrame:
        joined, point, helpers = self._combined(df, models)
        return joined.withColumn(out, ens.floor_at(point, self._floor)).drop(*helpers)

    def predict_with_intervals(
        self,
        df: DataFrame,
        models: ens.Models,
        bounds: Mapping[str, tuple[str, str]] | None = None,
        out: str = "forecast_ensemble",
        lower: str = "forecast_lower",
        upper: str = "forecast_upper",
    ) -> DataFrame:
        """Forecast with bounds: from the models' own bounds where any are given, else from
        their disagreement. Forecast and lower bound are floored, the upper bound is not."""
        joined, point, helpers = self._combined(df, models)
        if bounds:
            low, high = ens.given_intervals(models, self.weights, bounds)
        else:
            low, high = ens.spread_intervals(point, models, self.metrics.get("rmse"), self.confidence_level)
        return joined.withColumns(
            {
                out: ens.floor_at(point, self._floor),
                lower: ens.floor_at(low, self._floor),
                upper: high,
            }
        ).drop(*helpers)

    def save(self, folder: str) -> None:
        """Store the parts as small tables; segment keys keep their type."""
        spark = self.comparison.sparkSession
        config = spark.range(1).select(
            F.lit(self.method).alias("method"),
            F.lit(self.segment_col).cast("string").alias("segment_col"),
            F.lit(self.clip_predictions).alias("clip_predictions"),
            F.lit(float(self.min_prediction)).alias("min_prediction"),
            F.lit(float(self.confidence_level)).alias("confidence_level"),
            ens.weight_map(self.weights).alias("weights"),
            ens.weight_map(self.metrics).alias("metrics"),
        )
        write_parquet(config, f"{folder}/config")
        write_csv(self.comparison, f"{folder}/model_comparison")
        if self.blend is not None:
            rows = spark.range(1).select(
                ens.weight_map(self.blend.coefficients).alias("coefficients"),
                F.lit(float(self.blend.intercept)).alias("intercept"),
                F.lit(float(self.blend.alpha)).alias("alpha"),
            )
            write_parquet(rows, f"{folder}/blend")
        if self.segment_weights is not None:
            write_parquet(ens.weights_long(self.segment_weights), f"{folder}/segment_weights")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> EnsembleModel:
        config = spark.read.parquet(f"{folder}/config").first()
        comparison = spark.read.option("header", True).csv(f"{folder}/model_comparison")
        comparison = comparison.select(
            "model", *[F.col(c).cast("double").alias(c) for c in ens.COMPARISON_COLUMNS[1:]]
        )
        stored = read_table_or_empty(
            spark, f"{folder}/blend", "coefficients map<string,double>, intercept double, alpha double"
        ).first()
        blend = Blend(stored["coefficients"], stored["intercept"], stored["alpha"]) if stored else None
        by_segment = None
        if config["segment_col"] is not None:
            long = spark.read.parquet(f"{folder}/segment_weights")
            by_segment = long.groupBy("segment", "enough_rows").agg(
                F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("weights")
            )
        return EnsembleModel(
            config["method"],
            config["weights"],
            config["metrics"],
            comparison,
            blend,
            by_segment,
            config["segment_col"],
            config["clip_predictions"],
            config["min_prediction"],
            config["confidence_level"],
        )


def fit_ensemble(
    df: DataFrame,
    models: ens.Models,
    method: str = "inverse_error_weighted",
    actual: str = "sales",
    segment_col: str | None = None,
    order: tuple[str, ...] = ("date", "store_nbr", "family"),
    clip_predictions: bool = True,
    min_prediction: float = 0.0,
    confidence_level: float = 0.95,
) -> EnsembleModel:
    """Fit on validation rows that carry the actual and one column per model. The driver only
    receives one row of weights and one of metrics."""
    ens.require_models(models, method)
    check = ens.missing_forecasts(df, actual, models).first()
    if check["incomplete"]:
        raise ValueError(f"{check['incomplete']} of {check['rows']} rows lack an actual or a model forecast")
    blend = by_segment = None
    if method in ("simple_average", "weighted_average"):
        weights = ens.equal_weights(models)
    elif method.startswith("stacking"):
        blend = fit_blend(df, actual, models, order, regularized=method == "stacking_ridge")
        weights = blend.weights
    else:
        weights = ens.inverse_error_weights(df, actual, models).first()["weights"]
        if method == "dynamic_weighted" and segment_col is not None:
            by_segment = ens.segment_weights(df, actual, models, segment_col)
    model = EnsembleModel(
        method,
        weights,
        {},
        df,
        blend,
        by_segment,
        segment_col if by_segment is not None else None,
        clip_predictions,
        min_prediction,
        confidence_level,
    )
    joined, point, _ = model._combined(df, models)
    scored = joined.withColumn("_ensemble", point)
    comparison = ens.comparison_table(scored, actual, models, "_ensemble", method, weights)
    # one row per model plus the ensemble: collected once and kept as literals
    rows = comparison.collect()
    own = rows[-1].asDict()
    metrics = {k: own[k] for k in ens.COMPARISON_COLUMNS[2:]}
    table = df.sparkSession.createDataFrame(rows, comparison.schema)
    return replace(model, metrics=metrics, comparison=table)


def build_ensemble(
    validation: DataFrame,
    test: DataFrame,
    models: ens.Models,
    method: str = "inverse_error_weighted",
    actual: str = "sales",
    segment_col: str | None = None,
    bounds: Mapping[str, tuple[str, str]] | None = None,
    save_to: str | None = None,
) -> tuple[EnsembleModel, DataFrame]:
    """Fit on the validation rows and forecast the test rows with intervals."""
    model = fit_ensemble(validation, models, method, actual, segment_col)
    forecast = model.predict_with_intervals(test, models, bounds)
    if save_to:
        model.save(save_to)
    return model, forecast
