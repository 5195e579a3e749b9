"""Aggregates behind the diagnostic charts and the evaluation report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.quantiles import exact_quantiles, exact_quantiles_by
from shelfcast.sources.storage import stage

CELL_BITS = 14
MAGNITUDE_SCHEMA = (
    "bin int, lower_edge double, upper_edge double, n bigint, avg_actual double, mean_error double, "
    "median_error double, std_error double, rel_error double"
)


def error_by_magnitude(
    df: DataFrame, actual: str = "sales", predicted: str = "forecast_ensemble", bins: int = 10
) -> DataFrame:
    """Error statistics per quantile bin of the positive actuals. Bins are right-closed, the
    first also holds its lower edge, equal edges are merged; fewer than two edges give no bins."""
    narrow = df.where(F.col(actual) > 0).select(
        F.col(actual).alias("actual"), F.abs(F.col(actual) - F.col(predicted)).alias("error")
    )
    data = stage(narrow, "errors")  # two columns that five passes read
    found = exact_quantiles(data, "actual", [i / bins for i in range(bins + 1)])
    edges = sorted(set(found.values))
    if len(edges) < 2:
        return data.sparkSession.createDataFrame([], MAGNITUDE_SCHEMA)
    # the bin of a value is the number of edges after the first that lie below it
    below = [(F.col("actual") > F.lit(e)).cast("int") for e in edges[1:]]
    binned = data.withColumn("bin", reduce(add, below))
    medians = exact_quantiles_by(binned, "bin", "error", [0.5]).select(F.col("g").alias("bin"), F.col("values")[0].alias("median_error"))
    stats = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("actual").alias("avg_actual"),
        F.avg("error").alias("mean_error"),
        F.stddev_samp("error").alias("std_error"),
    )

    lower, upper = (F.array(*[F.lit(e) for e in x])[F.col("bin")] for x in (edges[:-1], edges[1:]))
    return stats.join(medians, "bin").select(
        "bin",
        lower.alias("lower_edge"),
        upper.alias("upper_edge"),
        "n",
        "avg_actual",
        "mean_error",
        "median_error",
        "std_error",
        (F.col("mean_error") / F.col("avg_actual")).alias("rel_error"),
    )


def residual_histogram(df: DataFrame, residual: str | Column, bins: int = 100) -> DataFrame:
    """Counts per equal-width bin between the extremes, with the overall mean residual."""
    r = F.col(residual) if isinstance(residual, str) else residual
    data = df.select(r.alias("r"))
    span = data.agg(F.struct(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean"))).scalar()
    width = (span["hi"] - span["lo"]) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("r") - span["lo"], width)), F.lit(0))
    return (
        data.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (span["lo"] + width * F.col("bin")).alias("lower_edge"),
            (span["lo"] + width * (F.col("bin") + 1)).alias("upper_edge"),
            "n",
            span["mean"].alias("mean_residual"),
        )
    )


def daily_bias(df: DataFrame, actual: str = "sales", predicted: str = "forecast_ensemble") -> DataFrame:
    return df.groupBy("date").agg(F.avg(F.col(actual) - F.col(predicted)).alias("residual"))


def rolling_bias(daily: DataFrame, days: int = 7) -> DataFrame:
    """Trailing mean of the daily bias; one row per date bounds the window."""
    w = Window.orderBy("date").rowsBetween(-(days - 1), 0)
    return daily.withColumn("rolling_bias", F.avg("residual").over(w))


def uniform_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """n rows (or all, if fewer) chosen by a hash of their key: without replacement and repeatable. The
    hashes are counted in CELLS ranges; whole ranges are taken by a filter, and only the range that
    holds the n-th row is sorted."""
    cell = F.shiftrightunsigned(F.xxhash64(*keys), 64 - CELL_BITS)
    counts = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))  # at most 2^CELL_BITS rows
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    last = placed.where((F.col("before") < n) & (F.col("before") + F.col("rows") > n)).first()
    if last is None:
        whole = placed.where(F.col("before") < n).agg(F.max("cell")).first()[0]
        return df.where(cell <= F.lit(-1 if whole is None else whole))
    rest = df.where(cell == last["cell"]).orderBy(F.xxhash64(*keys), *keys).limit(n - last["before"])
    return df.where(cell < last["cell"]).unionByName(rest)


# Labels and number formats of the report.
REPORT_LINES = [
    ("ACCURACY METRICS", None, None),
    ("  RMSE:                %.2f", "rmse", 1),
    ("  MAE:                 %.2f", "mae", 1),
    ("  MAPE:                %.4f", "mape", 1),
    ("  SMAPE:               %.4f", "smape", 1),
    ("  WAPE:                %.4f", "wape", 1),
    ("  R2:                  %.4f", "r2", 1),
    ("  Forecast Accuracy:   %.1f%%", "forecast_accuracy", 100),
    ("BIAS ANALYSIS", None, None),
    ("  Mean Bias:           %.2f", "mean_bias", 1),
    ("  Median Bias:         %.2f", "median_bias", 1),
    ("  Bias %%:              %.2f%%", "bias_pct", 1),
    ("ERROR DISTRIBUTION", None, None),
    ("  50th percentile:     %.2f", "error_p50", 1),
    ("  90th percentile:     %.2f", "error_p90", 1),
    ("  95th percentile:     %.2f", "error_p95", 1),
    ("  99th percentile:     %.2f", "error_p99", 1),
    ("FINANCIAL IMPACT", None, None),
    ("  Total Over-forecast: %.0f units", "total_over_forecast", 1),
    ("  Avg Over-forecast:   %.2f units/prediction", "avg_over_forecast", 1),
    ("  Total Under-forecast:%.0f units", "total_under_forecast", 1),
    ("  Avg Under-forecast:  %.2f units/prediction", "avg_under_forecast", 1),
    ("DIRECTIONAL ACCURACY", None, None),
    ("  Accuracy: %.1f%%", "directional_accuracy", 100),
]


def evaluation_report(metrics: DataFrame, model_name: str = "Model") -> DataFrame:
    """The one-row metrics as a text report; a metric without a value has no line."""
    lines = [F.lit(f"FORECAST EVALUATION REPORT: {model_name}")]
    for text, metric, factor in REPORT_LINES:
        if metric is None:
            lines.append(F.lit(text))
            continue
        value = F.col(metric) * factor
        lines.append(F.when(value.isNotNull(), F.format_string(text, value)))
        if metric == "bias_pct":
            over = F.when(F.col("mean_bias") > 0, "Over-forecasting").otherwise("Under-forecasting")
            lines.append(F.concat(F.lit("  Direction:           "), over))
    return metrics.select(F.concat_ws("\n", *lines).alias("report"))
