"""Lags and averages by calendar day, which know nothing of the row's own day or of later ones.

Row lags (features.add_lag_features) shift when a day is missing; these do not, and need no row for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip, ratio
from shelfcast.operators.joins import null_safe_join

SERIES = ("store_nbr", "family")
BLOCK_DAYS = 365


def add_day_lags(
    df: DataFrame,
    lags: Sequence[int] = (7, 14, 28),
    windows: Sequence[int] = (7, 28),
    value: str = "sales",
    series: Sequence[str] = SERIES,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Add {value}_day_lag_{k}, the mean value of the day k days before (NULL if it has no row), and
    {value}_day_mean_{w}, the mean of the rows of the w days before the row's day (NULL if there are none).

    A series is cut into blocks of `block_days` days, and the rows of a block's last days are also sent to the
    next one, so a long or crowded series spreads over many tasks. Rows without a date have no neighbours.
    """
    reach = max([*lags, *windows, 1])
    if not 0 < reach <= block_days or min([*lags, *windows, 1]) < 1:
        raise ValueError(f"lags and windows must lie in 1..{block_days} days")
    day = F.unix_date("date")
    own = F.floor(day / block_days).cast("int")
    tail = F.pmod(day, F.lit(block_days)) >= block_days - reach
    spread = df.withColumns({"_day": day, "_own": own}).withColumn(
        "_block", F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    w = Window.partitionBy(*series, "_block").orderBy("_day")
    named = {f"{value}_day_lag_{k}": F.avg(value).over(w.rangeBetween(-k, -k)) for k in lags}
    named |= {f"{value}_day_mean_{k}": F.avg(value).over(w.rangeBetween(-k, -1)) for k in windows}
    undated = F.col("date").isNull()
    columns = {name: F.when(~undated, c) for name, c in named.items()}
    return spread.withColumns(columns).where(F.col("_own").eqNullSafe(F.col("_block"))).drop("_day", "_own", "_block")


def store_means_before(df: DataFrame, columns: Sequence[str], cutoff: Column | None = None) -> DataFrame:
    """(store_nbr, date, _mean_<column>...): for every store and date of the table, the mean over the store's
    rows of earlier days, and with `cutoff` of days up to that one at most. Rows are summed by store and day
    first; such a table has a row per day and store, so its prefix sums are bounded by the calendar."""
    known = F.lit(True) if cutoff is None else F.coalesce(F.col("date") <= cutoff, F.lit(False))
    sums = [F.sum(F.when(known, F.col(c))).alias(f"_sum_{c}") for c in columns]
    counts = [F.count(F.when(known, F.col(c))).alias(f"_count_{c}") for c in columns]
    days = df.groupBy("store_nbr", "date").agg(*sums, *counts)
    before = Window.partitionBy("store_nbr").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    means = [F.try_divide(F.sum(f"_sum_{c}").over(before), F.sum(f"_count_{c}").over(before)).alias(f"_mean_{c}") for c in columns]
    return days.select("store_nbr", "date", *[F.when(F.col("date").isNotNull(), m).alias(f"_mean_{c}") for m, c in zip(means, columns, strict=True)])


def add_ratios_to_the_past(df: DataFrame, source: DataFrame | None = None, cutoff: Column | None = None) -> DataFrame:
    """Add promo_vs_store_past and txn_vs_store_past: promotions and transactions of the row against the mean
    of its store on earlier days; without a past, or with one of nothing, 0 and 1. Clipped as the ratios to
    the store's mean over all days are."""
    present = [c for c in ("onpromotion", "transactions") if c in df.columns]
    if not present:
        return df
    joined = null_safe_join(df, store_means_before(df if source is None else source, present, cutoff), ["store_nbr", "date"])
    named = {}
    if "onpromotion" in present:
        named["promo_vs_store_past"] = clip(ratio(F.col("onpromotion"), F.col("_mean_onpromotion"), 0.0), 0.0, 10.0)
    if "transactions" in present:
        named["txn_vs_store_past"] = clip(ratio(F.col("transactions"), F.col("_mean_transactions"), 1.0), 0.0, 5.0)
    return joined.withColumns(named).drop(*[f"_mean_{c}" for c in present])
