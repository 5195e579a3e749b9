"""Trend and seasonality of daily series.

A series is fitted by small least squares in the task that holds it; it has one row per day, so
its size is bounded by the calendar. Forecasts are column arithmetic on the fitted numbers.
Model form: trend * (1 + yearly + weekly + holiday), trend piecewise linear, seasons Fourier series.

The interval of a day is the spread of the residuals (for the freedom that the fit has used) and, after the
last day of the fit, that of the trend: bends go on as often as in the fit, their sizes drawn from a Laplace
distribution with the mean size of the fitted ones, so that a day at distance h has the variance
bends * 2 size^2 h^3 / 3 in units of the fitted span.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import pi
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip
from shelfcast.operators.joins import null_safe_join
from shelfcast.operators.metrics import aggregate, forecaster_metrics
from shelfcast.sources.storage import stage

# Series orders, periods, penalties and interval.
YEARLY_ORDER, YEAR_DAYS = 10, 365.25
WEEKLY_ORDER, WEEK_DAYS = 3, 7.0
HINGES = 5
TREND_PENALTIES = (0.001, 0.1, 10.0, 1000.0)  # of bends, in units of the rows; tried for each series
SLOPE_SHARE = 0.1  # of that, for the slope
SEASON_PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 1000.0)  # in units of the sum of squared levels; tried for each series
INTERVAL_Z = 1.96
MIN_DAYS = 30
FITTED = (
    "first_day int, days int, n int, trend array<double>, yearly array<double>, weekly array<double>, holiday double, sigma double, "
    "bend double, seasonal boolean"
)
_FIELDS = [f.strip().split(" ")[0] for f in FITTED.split(",")]


def daily_totals(df: DataFrame, target: str = "sales") -> DataFrame:
    return df.groupBy("date").agg(F.sum(target).alias("y"))


def series_totals(df: DataFrame, target: str = "sales") -> DataFrame:
    return df.groupBy("store_nbr", "family").agg(F.sum(target).alias("total"))


def top_series(df: DataFrame, n: int = 10, target: str = "sales") -> DataFrame:
    return series_totals(df, target).orderBy(F.desc("total"), "store_nbr", "family").limit(n)


def daily_by_series(df: DataFrame, target: str = "sales") -> DataFrame:
    """Daily values of every series; the fit takes the mean of one with fewer than MIN_DAYS days."""
    return df.groupBy("store_nbr", "family", "date").agg(F.sum(target).alias("y"))


def _fourier(day: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * pi * np.outer(day, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(angle), np.cos(angle)])


def _trend_basis(t: np.ndarray) -> np.ndarray:
    hinges = np.arange(1, HINGES + 1) / (HINGES + 1)
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - hinges, 0.0)])


def _fit_series(day: np.ndarray, y: np.ndarray, holiday: np.ndarray, min_days: int) -> tuple:
    first, span = int(day.min()), max(int(day.max() - day.min()), 1)
    y = np.asarray(y, dtype=float)
    scale = max(float(np.abs(y).max()), 1e-9)
    t, target = (day - first) / span, y / scale
    width, seasonal = 2 + HINGES, len(y) >= min_days
    if not seasonal:
        trend = np.zeros(width)
        trend[0] = target.mean()
        seasons = np.zeros(2 * YEARLY_ORDER + 2 * WEEKLY_ORDER + 1)
        error, used = target - target.mean(), 1.0
    else:
        basis = _trend_basis(t)
        season = np.hstack([_fourier(day, YEAR_DAYS, YEARLY_ORDER), _fourier(day, WEEK_DAYS, WEEKLY_ORDER), holiday[:, None]])
        tried = []
        for bend in TREND_PENALTIES:
            trend_penalty = np.r_[0.0, bend * len(y) * SLOPE_SHARE, np.full(HINGES, bend * len(y))] + 1e-9
            level = basis @ np.linalg.solve(basis.T @ basis + np.diag(trend_penalty), basis.T @ target)
            x = np.hstack([basis, level[:, None] * season])
            gram, moment = x.T @ x, x.T @ target  # once for all season penalties
            for s in SEASON_PENALTIES:
                ridge = gram + np.diag(np.r_[trend_penalty, np.full(season.shape[1], s * float(level @ level) + 1e-9)])
                solved = np.linalg.solve(ridge, np.column_stack([moment, gram]))
                both, used = solved[:, 0], float(np.trace(solved[:, 1:]))
                error = target - x @ both
                # generalised cross-validation: the error of the fit, raised by the freedom that it used
                tried.append((float(error @ error) / max(len(y) - used, 1e-3) ** 2, len(tried), both, error, used))
        _, _, both, error, used = min(tried, key=lambda x: x[:2])
        trend, seasons = both[:width], both[width:]
    return (
        first,
        span,
        len(y),
        (trend * scale).tolist(),
        seasons[: 2 * YEARLY_ORDER].tolist(),
        seasons[2 * YEARLY_ORDER : -1].tolist(),
        float(seasons[-1]),
        float(np.sqrt(error @ error / max(len(y) - used, 1.0)) * scale),
        float(np.abs(trend[2:]).mean() * scale),
        bool(seasonal),
    )


def fit_seasonal(daily: DataFrame, keys: Sequence[str], holidays: DataFrame | None = None, min_days: int = MIN_DAYS) -> DataFrame:
    """Fit each series of a table (keys..., date, y); without keys the table is one series. `holidays`, a
    table of dates, adds an effect of these days. A series of fewer than `min_days` days gets its mean;
    `seasonal` says which way it went."""
    keys = list(keys)
    by = keys or ["_all"]
    data = daily if keys else daily.withColumn("_all", F.lit(0))
    data = _with_holiday(data, holidays)
    data = data.select(*by, F.unix_date("date").alias("day"), F.col("y").cast("double").alias("y"), "_holiday")
    kinds = dict(data.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + FITTED
    names = _FIELDS

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fitted = _fit_series(rows["day"].to_numpy(), rows["y"].to_numpy(), rows["_holiday"].to_numpy(), min_days)
        return pd.DataFrame([dict(zip(by, key)) | dict(zip(names, fitted))])

    models = data.groupBy(*by).applyInPandas(fit, schema)
    return models if keys else models.drop("_all")


def _with_holiday(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """Add _holiday, 1.0 on the dates of the table, which has at most one row per day."""
    if holidays is None:
        return df.withColumn("_holiday", F.lit(0.0))
    days = holidays.select("date", F.lit(1.0).alias("_holiday")).distinct()
    return df.join(F.broadcast(days), "date", "left").na.fill(0.0, ["_holiday"])


def _dot(coefficients: Column, values: list[Column]) -> Column:
    return reduce(add, [coefficients[i] * v for i, v in enumerate(values)])


def _fourier_columns(day: Column, period: float, order: int) -> list[Column]:
    angles = [day * (2 * pi * k / period) for k in range(1, order + 1)]
    return [F.sin(a) for a in angles] + [F.cos(a) for a in angles]


def seasonal_columns(day: Column) -> dict[str, Column]:
    """Trend and the seasons' shares of it at a day number, from the columns of a fitted model."""
    t = (day - F.col("first_day")) / F.col("days")
    hinges = [F.greatest(t - k / (HINGES + 1), F.lit(0.0)) for k in range(1, HINGES + 1)]
    trend = _dot(F.col("trend"), [F.lit(1.0), t, *hinges])
    yearly = _dot(F.col("yearly"), _fourier_columns(day, YEAR_DAYS, YEARLY_ORDER))
    weekly = _dot(F.col("weekly"), _fourier_columns(day, WEEK_DAYS, WEEKLY_ORDER))
    return {"_trend": trend, "_yearly": yearly, "_weekly": weekly}


def forecast_dates(model: DataFrame, dates: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Forecast of a keyless model for a table of dates. Both are bounded: one row, one row
    per day; the model row is read as a scalar."""
    fitted = model.select(F.struct(*_FIELDS)).scalar()
    rows = _with_holiday(dates.select("date").distinct(), holidays).withColumn("_m", fitted)
    rows = rows.select("date", "_holiday", *[F.col(f"_m.{f}").alias(f) for f in _FIELDS])
    return _with_forecast(rows).select("date", "yhat", "yhat_lower", "yhat_upper", "trend_part", "yearly_part", "weekly_part")


def forecast_series(models: DataFrame, df: DataFrame, keys: Sequence[str], holidays: DataFrame | None = None) -> DataFrame:
    """Forecast for every row of a table by its own series' model; rows of unknown series get
    NULL, and `fitted` is false there. Fitted numbers join by key, the rest is column arithmetic."""
    joined = null_safe_join(_with_holiday(df, holidays), models, list(keys))
    out = _with_forecast(joined).withColumn("fitted", F.col("n").isNotNull())
    return out.drop(*_FIELDS, "_holiday")


def _with_forecast(rows: DataFrame) -> DataFrame:
    parts = rows.withColumns(seasonal_columns(F.unix_date("date")))
    trend, yearly, weekly = F.col("_trend"), F.col("_yearly"), F.col("_weekly")
    share = 1 + yearly + weekly + F.col("holiday") * F.col("_holiday")
    ahead = F.greatest((F.unix_date("date") - F.col("first_day")) / F.col("days") - 1, F.lit(0.0))
    trend_variance = HINGES * 2 * F.col("bend") * F.col("bend") * ahead * ahead * ahead / 3
    margin = INTERVAL_Z * F.sqrt(F.col("sigma") * F.col("sigma") + share * share * trend_variance)
    yhat = trend * share
    return parts.withColumns(
        {
            "yhat": yhat,
            "yhat_lower": yhat - margin,
            "yhat_upper": yhat + margin,
            "trend_part": trend,
            "yearly_part": yearly,
            "weekly_part": weekly,
        }
    ).drop("_trend", "_yearly", "_weekly")


@dataclass(frozen=True)
class TrainedSeasonal:
    """Fitted series and, for series that the training rows did not have, the mean of them all."""

    name: str
    models: DataFrame
    keys: list[str]
    target: str
    level: float
    holidays: DataFrame | None = None
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    training_seconds: float = 0.0

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the forecast, floored at 0, and `fitted`: whether it comes from the row's own series."""
        rows = forecast_series(self.models, df, self.keys, self.holidays)
        made = rows.withColumn(out, clip(F.coalesce(F.col("yhat"), F.lit(self.level)), 0.0))
        return made.select(*[c for c in df.columns if c not in (out, "fitted")], out, "fitted")

    def save(self, folder: str) -> None:
        spark = self.models.sparkSession
        self.models.write.mode("overwrite").parquet(f"{folder}/series")
        if self.holidays is not None:
            self.holidays.select("date").write.mode("overwrite").parquet(f"{folder}/holidays")
        about = json.dumps([self.name, self.keys, self.target, self.level, self.holidays is not None, self.metrics, self.training_seconds])
        spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{folder}/about")

    @staticmethod
    def load(folder: str) -> TrainedSeasonal:
        spark = SparkSession.getActiveSession()
        name, keys, target, level, has_days, metrics, seconds = json.loads(spark.read.parquet(f"{folder}/about").first()["about"])
        days = spark.read.parquet(f"{folder}/holidays") if has_days else None
        return TrainedSeasonal(name, spark.read.parquet(f"{folder}/series"), keys, target, level, days, metrics, seconds)


@dataclass(frozen=True)
class SeasonalForecaster:
    """A seasonal model for every series, with the interface of the tree forecasters. `features` of train is
    not used: the series' own dates are all it knows."""

    name: str = "prophet"
    keys: tuple[str, ...] = ("store_nbr", "family")
    min_days: int = MIN_DAYS

    def train(
        self, train: DataFrame, validation: DataFrame, features: list[str], target: str = "sales", holidays: DataFrame | None = None
    ) -> TrainedSeasonal:
        started = time.time()
        keys = list(self.keys)
        known = train.where(F.col(target).isNotNull())
        daily = known.groupBy(*keys, "date").agg(F.sum(target).alias("y"))
        models = stage(fit_seasonal(daily, keys, holidays, self.min_days), "fitted_series")
        level = known.agg(F.avg(target)).first()[0] or 0.0
        trained = TrainedSeasonal(self.name, models, keys, target, level, holidays)
        seconds = time.time() - started
        scores = {
            part: aggregate(trained.predict(rows), forecaster_metrics(target, "prediction")).first().asDict()
            for part, rows in (("train", train), ("validation", validation))
        }
        return TrainedSeasonal(self.name, models, keys, target, level, holidays, scores, seconds)


def validate_dates(forecast: DataFrame, validation: DataFrame, target: str = "sales") -> DataFrame:
    """Metrics of a forecast by date (date, yhat) against the daily totals of the validation rows: one row."""
    joined = daily_totals(validation, target).join(F.broadcast(forecast.select("date", "yhat")), "date", "left")
    return aggregate(joined, forecaster_metrics("y", "yhat"))


def validate_total(model: DataFrame, validation: DataFrame, target: str = "sales") -> DataFrame:
    """Metrics of the daily total forecast of a fitted model against the validation dates: one row."""
    return validate_dates(forecast_dates(model, validation), validation, target)


def predict_rows(forecast: DataFrame, df: DataFrame, out: str = "prophet_total_forecast") -> DataFrame:
    """Each row with the forecast of its date, floored at 0; one row per day is broadcast."""
    by_date = forecast.select("date", clip(F.col("yhat"), 0.0).alias(out))
    return df.join(F.broadcast(by_date), "date", "left")


def seasonal_features(model: DataFrame, df: DataFrame) -> DataFrame:
    """Forecast, trend and seasons of the daily total as features of each row, 0 if missing."""
    return with_date_parts(forecast_dates(model, df), df)


def with_date_parts(forecast: DataFrame, df: DataFrame) -> DataFrame:
    """Each row with the parts of the forecast of its date as features, 0 if missing."""
    parts = forecast.select(
        "date",
        F.col("yhat").alias("prophet_yhat"),
        F.col("trend_part").alias("prophet_trend"),
        F.col("yearly_part").alias("prophet_yearly"),
        F.col("weekly_part").alias("prophet_weekly"),
    )
    names = [c for c in parts.columns if c != "date"]
    return df.join(F.broadcast(parts), "date", "left").na.fill(0.0, names)
