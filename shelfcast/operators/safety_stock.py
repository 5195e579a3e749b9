"""Safety stock per segment."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import avg_where, ceil_units, ratio
from shelfcast.functions.service_level import z_score, z_value

METHODS = ("standard", "demand_and_lead_time", "forecast_error")
MAD_TO_STD = 1.25  # fixed value


@dataclass(frozen=True)
class SafetyStockSettings:
    service_level: float = 0.95
    lead_time_days: int = 7
    lead_time_std_days: float = 2.0

    def __post_init__(self) -> None:
        if not 0.5 <= self.service_level <= 0.999:
            raise ValueError("service_level must lie in 0.5..0.999")
        if not 1 <= self.lead_time_days <= 60:
            raise ValueError("lead_time_days must lie in 1..60")


def standard(z: Column, demand_std: Column, lead_time: Column) -> Column:
    return ceil_units(z * demand_std * F.sqrt(lead_time))


def demand_and_lead_time(
    z: Column, avg_demand: Column, demand_std: Column, lead_time: Column, lead_time_std: Column
) -> Column:
    variance = lead_time * demand_std * demand_std + avg_demand * avg_demand * lead_time_std * lead_time_std
    return ceil_units(z * F.sqrt(variance))


def forecast_error(z: Column, error_std: Column, mad: Column, lead_time: Column) -> Column:
    return ceil_units(z * F.greatest(error_std, mad * MAD_TO_STD) * F.sqrt(lead_time))


def _with_service_level(
    stats: DataFrame, levels: Mapping | DataFrame | None, default: float
) -> DataFrame:
    """Add each segment's service level and its z-score. Levels known on the driver give literal
    z-scores; levels from a table are evaluated per segment."""
    if isinstance(levels, DataFrame):
        table = levels.select("segment", F.col("service_level").alias("_level"))
        stats = stats.join(table, "segment", "left")
        level = F.coalesce("_level", F.lit(float(default)))
        return stats.withColumn("service_level", level).withColumn("z_score", z_score(F.col("service_level")))

    def pick(of: Callable[[float], float]) -> Column:
        if not levels:
            return F.lit(of(float(default)))
        pairs = [F.lit(x) for k, v in levels.items() for x in (k, of(float(v)))]
        return F.coalesce(F.create_map(*pairs)[F.col("segment")], F.lit(of(float(default))))

    return stats.withColumns({"service_level": pick(lambda v: v), "z_score": pick(z_value)})


def safety_stock(
    forecasts: DataFrame,
    segment_col: str = "store_nbr",
    actual_col: str = "sales",
    forecast_col: str = "forecast_ensemble",
    method: str = "forecast_error",
    service_levels: Mapping | DataFrame | None = None,
    settings: SafetyStockSettings = SafetyStockSettings(),
) -> DataFrame:
    """Safety stock of every segment from one pre-aggregated pass over the forecasts.
    `service_levels` is a mapping or a table (segment, service_level) of exceptions."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    actual, error = F.col(actual_col), F.col(actual_col) - F.col(forecast_col)
    stats = forecasts.groupBy(F.col(segment_col).alias("segment")).agg(
        F.avg(actual).alias("avg_daily_demand"),
        F.stddev_pop(actual).alias("demand_std"),
        F.stddev_pop(error).alias("forecast_error_std"),
        F.avg(F.abs(error)).alias("_mad"),
        avg_where(F.abs(error) / actual, actual > 0, 0.0).alias("forecast_mape"),
        F.count(F.lit(1)).alias("n_observations"),
    )
    stats = _with_service_level(stats, service_levels, settings.service_level)
    z, lead = F.col("z_score"), F.lit(float(settings.lead_time_days))
    demand, std = F.col("avg_daily_demand"), F.col("demand_std")
    stock = {
        "standard": standard(z, std, lead),
        "demand_and_lead_time": demand_and_lead_time(
            z, demand, std, lead, F.lit(float(settings.lead_time_std_days))
        ),
        "forecast_error": forecast_error(z, F.col("forecast_error_std"), F.col("_mad"), lead),
    }[method]
    with_stock = stats.withColumn("safety_stock", stock)
    days = F.when(demand > 0, ratio(F.col("safety_stock"), demand, 0.0)).otherwise(0.0)
    return with_stock.select(
        "segment",
        F.lit(segment_col).alias("segment_col"),
        "avg_daily_demand",
        "demand_std",
        "forecast_error_std",
        "forecast_mape",
        "service_level",
        "z_score",
        F.lit(settings.lead_time_days).alias("lead_time_days"),
        "safety_stock",
        days.alias("safety_stock_days"),
        F.lit(method).alias("method"),
        "n_observations",
    )
