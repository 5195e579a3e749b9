"""Days on which actuals and forecasts part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip, ratio
from shelfcast.operators.joins import null_safe_join
from shelfcast.sources.storage import stage


def detect_anomalies(
    df: DataFrame,
    actual_col: str = "sales",
    forecast_col: str = "forecast_ensemble",
    segment_cols: Sequence[str] = (),
    z_threshold: float = 3.0,
    pct_threshold: float = 0.5,
    levels: Sequence[Sequence[str]] = (),
    min_samples: int = 30,
) -> DataFrame:
    """Rows whose deviation exceeds the percentage threshold, or the z threshold against the
    mean and sample deviation of all rows. The two numbers come from one aggregate; the rows
    themselves are not shuffled and not sorted.

    `levels`, finest first and each a part of the one before, measure a row against its own segment:
    of the first level whose segment has `min_samples` deviations or more, and of all rows where none has.
    The result then has `baseline`, the level's columns or "all", and the number of its deviations,
    `baseline_n`. NULL is a segment like any other."""
    actual, forecast = F.col(actual_col), F.col(forecast_col)
    deviation = actual - forecast
    if levels:
        df = _with_baseline(df, deviation, [list(x) for x in levels], min_samples)
        stats, extra = F.col("_stats"), ["baseline", "baseline_n"]
    else:
        stats, extra = df.agg(F.struct(F.avg(deviation).alias("mean"), F.stddev_samp(deviation).alias("std"))).scalar(), []
    pct = F.when(forecast > 0, ratio(deviation, forecast, 0.0)).otherwise(0.0)
    z = F.when(stats["std"] > 0, (deviation - stats["mean"]) / stats["std"]).otherwise(0.0)
    kept = [c for c in segment_cols if c in df.columns]
    scored = df.select(
        *kept,
        "date",
        actual_col,
        forecast_col,
        deviation.alias("deviation"),
        pct.alias("pct_deviation"),
        z.alias("_z"),
        *extra,
    )
    flagged = scored.where((F.abs("pct_deviation") > pct_threshold) | (F.abs("_z") > z_threshold))
    severity = clip(F.abs("pct_deviation") * 100 + F.abs("_z") * 10, 0, 100)
    kind = (
        F.when(F.col("deviation") > 0, "Spike").when(F.col("deviation") < 0, "Drop").otherwise("Normal")
    )
    return flagged.withColumns({"severity": severity, "anomaly_type": kind}).drop("_z")


def _with_baseline(df: DataFrame, deviation: Column, levels: list[list[str]], min_samples: int) -> DataFrame:
    """Add _stats (mean, std), baseline and baseline_n. The rows are aggregated once, by the finest level;
    the moments of the coarser ones are merged from those."""
    for finer, coarser in zip(levels, levels[1:]):
        if not set(coarser) <= set(finer):
            raise ValueError(f"{coarser} is no part of {finer}")
    n, mean = F.count(deviation).alias("n"), F.coalesce(F.avg(deviation), F.lit(0.0)).alias("mean")
    # squares about the mean, which merge without loss where values are large
    finest = stage(df.groupBy(*levels[0]).agg(n, mean, F.coalesce(F.var_pop(deviation) * F.count(deviation), F.lit(0.0)).alias("m2")), "moments")

    def merged(keys: list[str]) -> DataFrame:
        total, center = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
        squares = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - total * center * center
        return finest.groupBy(*keys).agg(total.alias("n"), center.alias("mean"), F.greatest(squares, F.lit(0.0)).alias("m2"))

    def stats(name: str) -> Column:
        std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
        return F.struct(F.lit(name).alias("level"), "n", "mean", std.alias("std"))

    everything = merged([]).select(stats("all")).scalar()
    known = finest.select(*levels[0], stats(", ".join(levels[0])).alias("_level0"))
    for i, keys in enumerate(levels[1:], 1):
        known = null_safe_join(known, merged(keys).select(*keys, stats(", ".join(keys)).alias(f"_level{i}")), keys)
    enough = [F.when(F.col(f"_level{i}.n") >= min_samples, F.col(f"_level{i}")) for i in range(len(levels))]
    chosen = known.select(*levels[0], F.coalesce(*enough, everything).alias("_stats"))
    return null_safe_join(df, chosen, levels[0]).withColumns({"baseline": F.col("_stats.level"), "baseline_n": F.col("_stats.n")})


def ranked(anomalies: DataFrame, tiebreak: Sequence[str] = ("date",)) -> DataFrame:
    return anomalies.orderBy(F.desc("severity"), *tiebreak)


def top_anomalies(anomalies: DataFrame, n: int = 10, tiebreak: Sequence[str] = ("date",)) -> DataFrame:
    return ranked(anomalies, tiebreak).limit(n)


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Counts and severity in one row, 0 where there is no anomaly."""
    return anomalies.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("anomaly_type") == "Spike").alias("spikes"),
        F.count_if(F.col("anomaly_type") == "Drop").alias("drops"),
        F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.max("severity"), F.lit(0.0)).alias("max_severity"),
    )


def describe(
    anomalies: DataFrame,
    store_col: str = "store_nbr",
    family_col: str = "family",
    actual_col: str = "sales",
    forecast_col: str = "forecast_ensemble",
) -> DataFrame:
    """Deviation in percent, direction and a short text of each anomaly."""
    actual, expected = F.col(actual_col), F.col(forecast_col)
    pct = F.when(expected > 0, (actual - expected) / expected * 100).otherwise(0.0)
    direction = F.when(actual > expected, "higher").otherwise("lower")
    text = F.format_string(
        "Store: %s; Category: %s; Date: %s; Expected: %.0f units; Actual: %.0f units; "
        "Deviation: %+.1f%% (%s than expected)",
        F.col(store_col).cast("string"),
        family_col,
        F.col("date").cast("string"),
        expected,
        actual,
        pct,
        direction,
    )
    return anomalies.withColumns(
        {"deviation_pct": pct, "direction": direction, "description": text}
    )
