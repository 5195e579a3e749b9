"""Forecast accuracy metrics. Three families differ in detail and are kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip, col, ratio
from shelfcast.operators.ordinal import lag_by_position, with_global_position
from shelfcast.operators.quantiles import exact_quantiles_by
from shelfcast.sources.storage import stage

INF = float("inf")


def _sum_squares(x: Column) -> Column:
    return F.sum(x * x)


def _spread(a: Column) -> Column:
    """Sum of squares around the mean."""
    return F.var_pop(a) * F.count(a)


def _r2(a: Column, error: Column) -> Column:
    residual, total = _sum_squares(error), _spread(a)
    return (
        F.when(total > 0, 1 - F.try_divide(residual, total))
        .when(residual == 0, 1.0)
        .otherwise(0.0)
    )


def _mape(a: Column, error: Column, empty: float | None) -> Column:
    value = F.avg(F.when(a > 0, F.abs(error) / a))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def _smape(a: Column, p: Column, error: Column) -> Column:
    half = (F.abs(a) + F.abs(p)) / 2
    return F.avg(F.abs(error) / F.when(half == 0, 1.0).otherwise(half))


def _wape(a: Column, error: Column) -> Column:
    return F.try_divide(F.sum(F.abs(error)), F.sum(F.abs(a)))


def forecaster_metrics(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """Aggregates a single forecaster is scored with: predictions are floored at 0, percentages
    are times 100 and values are rounded."""
    a, p = col(actual), clip(col(predicted), 0.0)
    e = a - p
    total = F.abs(a) + F.abs(p)
    smape = F.avg(2 * F.abs(e) / F.when(total == 0, 1.0).otherwise(total))
    spread = _spread(a)
    r2 = F.when(spread > 0, 1 - F.try_divide(_sum_squares(e), spread)).otherwise(0.0)
    log_gap = F.log1p(p) - F.log1p(a)
    return {
        "mae": F.round(F.avg(F.abs(e)), 4),
        "rmse": F.round(F.sqrt(F.avg(e * e)), 4),
        "mape": F.round(_mape(a, e, INF) * 100, 4),
        "smape": F.round(smape * 100, 4),
        "r2": F.round(r2, 4),
        "rmsle": F.round(F.sqrt(F.avg(log_gap * log_gap)), 6),
    }


def ensemble_metrics(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """Aggregates models and ensembles are compared with; fractions, no flooring."""
    a, p = col(actual), col(predicted)
    e = a - p
    wape = F.coalesce(_wape(a, e), F.lit(INF))
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mape": _mape(a, e, INF),
        "smape": _smape(a, p, e),
        "wape": wape,
        "r2": _r2(a, e),
        "forecast_accuracy": F.greatest(F.lit(0.0), 1 - wape),
        "bias": F.avg(p - a),
    }


def evaluator_metrics(actual: str | Column, predicted: str | Column) -> dict[str, Column]:
    """Aggregates of a full evaluation that need no order or quantile."""
    a, p = col(actual), col(predicted)
    e = a - p
    over, under = clip(-e, 0.0), clip(e, 0.0)
    bias, mean = F.avg(p - a), F.avg(a)
    wape = _wape(a, e)
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": _r2(a, e),
        "mape": _mape(a, e, None),
        "smape": _smape(a, p, e),
        "wape": wape,
        "mean_bias": bias,
        "bias_pct": F.when(mean > 0, ratio(bias, mean, 0.0) * 100).otherwise(0.0),
        "total_over_forecast": F.sum(over),
        "avg_over_forecast": F.avg(over),
        "total_under_forecast": F.sum(under),
        "avg_under_forecast": F.avg(under),
        "forecast_accuracy": F.greatest(F.lit(0.0), 1 - F.coalesce(wape, F.lit(1.0))),
    }


def aggregate(df: DataFrame, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    aggs = [c.alias(name) for name, c in metrics.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def residual_columns(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    residual = F.col(actual) - F.col(predicted)
    return df.withColumns(
        {
            "residual": residual,
            "abs_residual": F.abs(residual),
            "pct_error": F.when(F.col(actual) > 0, residual / F.col(actual)).otherwise(0.0),
        }
    )


def directional_accuracy(
    df: DataFrame,
    actual: str,
    predicted: str,
    series: Sequence[str] = ("store_nbr", "family"),
    order: Sequence[str] = ("date",),
) -> DataFrame:
    """Share of consecutive rows of a series where actual and prediction move the same way,
    over all pairs of all series: one row. Without `series` the whole table is one, which is cut
    into ranges of `order`; rows that are equal in it stand in order of actual and prediction."""
    now = F.struct(F.col(actual).alias("a"), F.col(predicted).alias("p"))
    if series:
        w = Window.partitionBy(*series).orderBy(*order)
        pairs = df.select(now.alias("now"), F.lag(now).over(w).alias("then"))
    else:
        ranked = with_global_position(df.select(*order, now.alias("now")), [*order, "now"])
        pairs = lag_by_position(ranked.select("pos", "now"), [], "pos", "now", 1, "then")
    moves = pairs.select(
        F.signum(F.col("now.a") - F.col("then.a")).alias("_a"),
        F.signum(F.col("now.p") - F.col("then.p")).alias("_p"),
    )
    return moves.agg(F.avg((F.col("_a") == F.col("_p")).cast("double")).alias("directional_accuracy"))


def evaluate(
    df: DataFrame,
    actual: str = "sales",
    predicted: str = "forecast_ensemble",
    series: Sequence[str] = ("store_nbr", "family"),
    order: Sequence[str] = ("date",),
) -> DataFrame:
    """All evaluation metrics in one row, quantiles exact (and computed on the call)."""
    probs = (0.5, 0.9, 0.95, 0.99)
    df = stage(df.select(*dict.fromkeys([actual, predicted, *series, *order])), "evaluated")  # four passes read it
    bias = F.col(predicted) - F.col(actual)
    # both measures in the same passes, as two groups
    measures = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("g"), m.alias("v")) for i, m in enumerate((F.abs(bias), bias))])).alias("m"))
    found = {r["g"]: r["values"] for r in exact_quantiles_by(measures, "m.g", "m.v", probs).collect()}
    nothing = [float("nan")] * len(probs)
    tails, median = found.get(0, nothing), found.get(1, nothing)[0]
    direction = directional_accuracy(df, actual, predicted, series, order).scalar()
    return aggregate(df, evaluator_metrics(actual, predicted)).withColumns(
        {
            "median_bias": F.lit(median),
            "directional_accuracy": direction,
            **{f"error_p{p * 100:.0f}": F.lit(v) for p, v in zip(probs, tails)},
        }
    )


def segment_metrics(
    df: DataFrame,
    segment_col: str,
    actual: str = "sales",
    predicted: str = "forecast_ensemble",
    min_rows: int = 5,
) -> DataFrame:
    """Accuracy per segment; enough_rows tells whether it has `min_rows` rows. Rows without an actual or
    a forecast count in no measure, only in n_missing."""
    a, p = F.col(actual), F.col(predicted)
    bias, mean = F.avg(p - a), F.avg(a)
    return (
        df.groupBy(F.col(segment_col).alias("segment"))
        .agg(
            F.count(a - p).alias("n_samples"),
            F.count_if((a - p).isNull()).alias("n_missing"),
            mean.alias("avg_actual"),
            F.avg(p).alias("avg_predicted"),
            F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
            F.avg(F.abs(a - p)).alias("mae"),
            _mape(a, a - p, INF).alias("mape"),
            bias.alias("bias"),
            F.when(mean > 0, ratio(bias, mean, 0.0) * 100).otherwise(0.0).alias("bias_pct"),
        )
        .withColumn("enough_rows", F.col("n_samples") >= min_rows)
    )


def best_and_worst(segments: DataFrame, n: int = 3) -> DataFrame:
    """The n segments of lowest and of highest RMSE, tagged."""
    best = segments.orderBy("rmse", "segment").limit(n).withColumn("side", F.lit("best"))
    worst = segments.orderBy(F.desc("rmse"), F.desc("segment")).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
