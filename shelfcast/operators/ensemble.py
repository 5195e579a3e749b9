"""Combining model forecasts: weights, combination, intervals, comparison, summary.

Model forecasts are columns of one table. Weights are either plain numbers or a map column, so
that fitted weights can stay part of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import col
from shelfcast.operators.joins import null_safe_join
from shelfcast.operators.metrics import aggregate, ensemble_metrics
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.operators.stacking import Blend

# Fixed values.
METHODS = (
    "simple_average",
    "weighted_average",
    "inverse_error_weighted",
    "stacking_ridge",
    "stacking_linear",
    "dynamic_weighted",
)
EPSILON = 1e-10
MIN_SEGMENT_ROWS = 10
INTERVAL_Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
DEFAULT_Z = 1.96

Models = Mapping[str, str | Column]
Weights = Mapping[str, float] | Column


def weight_map(weights: Mapping[str, float | Column]) -> Column:
    pairs = []
    for name, w in weights.items():
        pairs += [F.lit(name), w if isinstance(w, Column) else F.lit(float(w))]
    return F.create_map(*pairs)


def weight_of(weights: Weights, name: str) -> Column:
    """A model's weight; a model without one counts 0."""
    if isinstance(weights, Column):
        return F.coalesce(weights[name], F.lit(0.0))
    return F.lit(float(weights.get(name, 0.0)))


def equal_weights(models: Models) -> dict[str, float]:
    return {name: 1.0 / len(models) for name in models}


def _inverse_errors(actual: str, models: Models) -> Column:
    a = F.col(actual)
    inverse = {
        name: 1.0 / (F.sqrt(F.avg((a - col(c)) * (a - col(c)))) + EPSILON) for name, c in models.items()
    }
    total = reduce(add, inverse.values())
    return weight_map({name: v / total for name, v in inverse.items()})


def inverse_error_weights(df: DataFrame, actual: str, models: Models) -> DataFrame:
    """One row with a map of weights in proportion to 1 / RMSE."""
    return df.agg(_inverse_errors(actual, models).alias("weights"))


def segment_weights(
    df: DataFrame, actual: str, models: Models, segment_col: str, min_rows: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """Weights per segment from one pre-aggregated pass. A segment of fewer than `min_rows` rows weighs all
    models alike; `enough_rows` says which way it went."""
    fitted, even = _inverse_errors(actual, models), weight_map(equal_weights(models))
    enough = F.count(F.lit(1)) >= min_rows
    return df.groupBy(F.col(segment_col).alias("segment")).agg(
        enough.alias("enough_rows"), F.when(enough, fitted).otherwise(even).alias("weights")
    )


def weights_long(weights: DataFrame) -> DataFrame:
    """(…, model, weight) rows of a table with a `weights` map."""
    rest = [c for c in weights.columns if c != "weights"]
    return weights.select(*rest, F.explode("weights").alias("model", "weight"))


def combine(models: Models, weights: Weights) -> Column:
    return reduce(add, [weight_of(weights, n) * col(c) for n, c in models.items()])


def combine_blend(models: Models, blend: Blend) -> Column:
    parts = [F.lit(blend.coefficients[n]) * col(models[n]) for n in sorted(models)]
    return F.lit(blend.intercept) + reduce(add, parts)


def with_segment_weights(
    df: DataFrame, by_segment: DataFrame, global_weights: Weights, segment_col: str, out: str = "_weights"
) -> DataFrame:
    """Attach each row's weights: its segment's, else the global ones."""
    fallback = global_weights if isinstance(global_weights, Column) else weight_map(global_weights)
    table = by_segment.select(F.col("segment").alias(segment_col), F.col("weights").alias("_own"))
    joined = null_safe_join(df, table, [segment_col])
    return joined.withColumn(out, F.coalesce("_own", fallback)).drop("_own")


def floor_at(x: Column, minimum: float | None) -> Column:
    return x if minimum is None else F.when(x.isNotNull(), F.greatest(x, F.lit(float(minimum))))


def model_spread(models: Models) -> Column:
    """Population standard deviation of a row's model forecasts."""
    cols = [col(c) for c in models.values()]
    mean = reduce(add, cols) / len(cols)
    return F.sqrt(reduce(add, [(c - mean) * (c - mean) for c in cols]) / len(cols))


def spread_intervals(
    point: Column, models: Models, validation_rmse: float | Column | None, confidence: float = 0.95
) -> tuple[Column, Column]:
    """Bounds from model disagreement, which counts at least half the validation RMSE."""
    width = model_spread(models)
    if validation_rmse is not None:
        rmse = validation_rmse if isinstance(validation_rmse, Column) else F.lit(float(validation_rmse))
        width = F.greatest(width, rmse * 0.5)
    z = INTERVAL_Z.get(confidence, DEFAULT_Z)
    return point - z * width, point + z * width


def given_intervals(
    models: Models, weights: Weights, bounds: Mapping[str, tuple[str | Column, str | Column]]
) -> tuple[Column, Column]:
    """Weighted sums of the models' own bounds; a model without bounds uses its forecast plus
    and minus the models' spread."""
    spread = model_spread(models)
    lows, highs = [], []
    for name, c in models.items():
        w = weight_of(weights, name)
        low, high = col(c) - spread, col(c) + spread
        if name in bounds:
            given_low, given_high = (col(b) for b in bounds[name])
            low, high = F.coalesce(given_low, low), F.coalesce(given_high, high)
        lows.append(w * low)
        highs.append(w * high)
    return reduce(add, lows), reduce(add, highs)


COMPARISON_COLUMNS = [
    "model", "weight", "rmse", "mae", "mape", "smape", "wape", "r2", "forecast_accuracy", "bias",
]


def comparison_table(
    df: DataFrame, actual: str, models: Models, ensemble: str | Column, method: str, weights: Weights
) -> DataFrame:
    """Metrics of every model and of the ensemble, one row each, from one pass over the rows."""
    entries = {**models, f"ENSEMBLE ({method})": ensemble}
    metrics = {name: ensemble_metrics(actual, c) for name, c in entries.items()}
    names = list(next(iter(metrics.values())))
    aggs = [m[k].alias(f"{k}{i}") for i, m in enumerate(metrics.values()) for k in names]
    rows = []
    for i, name in enumerate(entries):
        weight = weight_of(weights, name) if name in models else F.lit(1.0)
        rows.append(
            F.struct(
                F.lit(name).alias("model"),
                weight.alias("weight"),
                *[F.col(f"{k}{i}").alias(k) for k in COMPARISON_COLUMNS[2:]],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def best_model(comparison: DataFrame) -> DataFrame:
    """One row: model of lowest RMSE, whether it is the ensemble, and the ensemble's gap in %."""
    is_ensemble = F.col("model").startswith("ENSEMBLE")
    return comparison.agg(
        F.min_by("model", F.struct("rmse", "model")).alias("best_model"),
        F.min("rmse").alias("_best"),
        F.min(F.when(is_ensemble, F.col("rmse"))).alias("_ensemble"),
    ).select(
        "best_model",
        F.col("best_model").startswith("ENSEMBLE").alias("ensemble_is_best"),
        (F.try_divide(F.col("_ensemble") - F.col("_best"), F.col("_best")) * 100).alias("gap_pct"),
    )


def contribution_table(
    weights: DataFrame, metrics: DataFrame, importances: DataFrame | None = None, top: int = 5
) -> DataFrame:
    """Weight and standalone quality of each model. `metrics` has (model, rmse, mape,
    training_time_s); `importances` has (model, feature, importance)."""
    out = weights.select("model", "weight").join(
        metrics.select(
            "model",
            F.col("rmse").alias("standalone_rmse"),
            F.col("mape").alias("standalone_mape"),
            "training_time_s",
        ),
        "model",
        "left",
    )
    if importances is None:
        return out
    by_rank = F.array_sort(
        F.collect_list(F.struct((-F.col("importance")).alias("r"), F.col("feature").alias("f")))
    )
    best = importances.groupBy("model").agg(
        F.transform(F.slice(by_rank, 1, top), lambda x: x["f"]).alias("top_features")
    )
    return out.join(best, "model", "left")


def summary_stats(df: DataFrame, forecast_col: str) -> DataFrame:
    """Totals and spread of the forecasts in one row; the median is exact."""
    median = exact_quantiles(df, forecast_col, [0.5]).values[0]
    f = F.col(forecast_col)
    return df.agg(
        F.sum(f).alias("total_forecasted_sales"),
        F.avg(f).alias("avg_daily_sales"),
        F.max(f).alias("max_daily_sales"),
        F.min(f).alias("min_daily_sales"),
        F.stddev_pop(f).alias("std_daily_sales"),
        F.count(F.lit(1)).alias("forecast_count"),
    ).withColumn("median_daily_sales", F.lit(median))


def _with_empty_periods(totals: DataFrame, spine: Column) -> DataFrame:
    """Insert the periods without rows as 0; periods are bounded by the calendar."""
    periods = totals.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(
        F.explode(spine).alias("period")
    )
    return periods.join(totals, "period", "left").select(
        "period", F.coalesce("total", F.lit(0.0)).alias("total")
    )


def weekly_totals(df: DataFrame, forecast_col: str) -> DataFrame:
    """Sums of weeks labelled by their closing Sunday."""
    sunday = F.next_day(F.date_sub("date", 1), "SUN")
    totals = df.groupBy(sunday.alias("period")).agg(F.sum(forecast_col).alias("total"))
    return _with_empty_periods(totals, F.expr("sequence(lo, hi, interval 7 days)"))


def monthly_totals(df: DataFrame, forecast_col: str) -> DataFrame:
    """Sums of months labelled by their last day."""
    totals = df.groupBy(F.last_day("date").alias("period")).agg(F.sum(forecast_col).alias("total"))
    firsts = F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), interval 1 month)")
    return _with_empty_periods(totals, F.transform(firsts, F.last_day))


def store_totals(df: DataFrame, forecast_col: str, store_col: str = "store_nbr") -> DataFrame:
    return df.groupBy(F.col(store_col).alias("store")).agg(F.sum(forecast_col).alias("total"))


def top_and_bottom(totals: DataFrame, n: int = 5) -> DataFrame:
    top = totals.orderBy(F.desc("total"), "store").limit(n).withColumn("side", F.lit("top"))
    bottom = totals.orderBy("total", "store").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def forecast_summary(
    df: DataFrame,
    forecast_col: str,
    method: str,
    weights: Weights,
    accuracy: float | Column | None = None,
    dated: bool = True,
    store_col: str | None = "store_nbr",
) -> DataFrame:
    """The whole summary as one nested row: statistics, weekly and monthly totals by label, the
    five largest and smallest stores."""

    def as_map(table: DataFrame, key: Column) -> Column:
        return table.agg(F.map_from_entries(F.collect_list(F.struct(key.cast("string"), "total")))).scalar()

    extra = {
        "ensemble_method": F.lit(method),
        "model_weights": weights if isinstance(weights, Column) else weight_map(weights),
        "ensemble_accuracy": accuracy if isinstance(accuracy, Column) else F.lit(accuracy).cast("double"),
    }
    if dated:
        extra["weekly_forecast"] = as_map(weekly_totals(df, forecast_col), F.col("period"))
        extra["monthly_forecast"] = as_map(monthly_totals(df, forecast_col), F.col("period"))
    if store_col:
        ends = top_and_bottom(store_totals(df, forecast_col, store_col))
        for side in ("top", "bottom"):
            extra[f"{side}_5_stores"] = as_map(ends.where(F.col("side") == side), F.col("store"))
    stats = summary_stats(df, forecast_col)
    return stats.select("*", *[c.alias(k) for k, c in extra.items()])


def validation_row(df: DataFrame, actual: str, predicted: str | Column) -> DataFrame:
    return aggregate(df, ensemble_metrics(actual, predicted))


def missing_forecasts(df: DataFrame, actual: str, models: Models) -> DataFrame:
    """One row: rows in total and rows where the actual or a model has no value."""
    missing = reduce(lambda x, y: x | y, [col(c).isNull() for c in models.values()], F.col(actual).isNull())
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("incomplete"))


def require_models(models: Sequence[str] | Models, method: str) -> None:
    if len(models) < 2:
        raise ValueError(f"an ensemble is made of two or more models, not {len(models)}")
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method {method!r}; known are {METHODS}")
