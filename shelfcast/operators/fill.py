"""Filling gaps along the calendar. Date tables have at most one row per day, which bounds
both the single-task windows here and the broadcasts of such tables elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar_order() -> Window:
    return Window.orderBy("date")


def fill_both_ways(x: str) -> Column:
    """Last known value on or before the date, else the first known one after it."""
    w = calendar_order()
    return F.coalesce(
        F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    )


def daily_calendar(df: DataFrame) -> DataFrame:
    """One row per day from the first to the last date of a table."""
    return df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )


def densify_daily(dates: DataFrame) -> DataFrame:
    """Insert the missing days of a table keyed by date; new rows are NULL elsewhere."""
    return daily_calendar(dates).join(dates, "date", "left")


def first_per_date(df: DataFrame, tiebreak: str) -> DataFrame:
    """Keep, for each date, the row with the lowest tiebreak value. Works as a map-side
    combined aggregate, so a date with very many rows never meets in one window."""
    rest = [c for c in df.columns if c not in ("date", tiebreak)]
    kept = df.groupBy("date").agg(F.min_by(F.struct(*rest), F.col(tiebreak)).alias("_row"))
    return kept.select("date", "_row.*")
