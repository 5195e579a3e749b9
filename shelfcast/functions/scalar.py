"""Small numeric helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound x on either side; a NULL stays NULL (greatest/least alone would skip it)."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def ratio(num: Column, den: Column, default: float | None) -> Column:
    """num / den, with `default` where the division has no value."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def ceil_units(x: Column) -> Column:
    """Round up to whole units, never below zero; NULL stays NULL."""
    return clip(F.ceil(x).cast("double"), 0.0)


def avg_where(x: Column, condition: Column, default: float) -> Column:
    return F.coalesce(F.avg(F.when(condition, x)), F.lit(float(default)))


def money(v: Column, billions_decimals: int = 2) -> Column:
    """Short money text: $1.25B, $12.5M, $350K, $999."""
    a = F.abs(v)
    billions = f"$%.{billions_decimals}fB"
    return (
        F.when(v.isNull() | (v == 0), F.lit("$0"))
        .when(a >= 1e9, F.format_string(billions, v / 1e9))
        .when(a >= 1e6, F.format_string("$%.1fM", v / 1e6))
        .when(a >= 1e3, F.format_string("$%.0fK", v / 1e3))
        .otherwise(F.format_string("$%,.0f", v))
    )


def percent(v: Column, decimals: int = 1) -> Column:
    return F.when(v.isNull(), F.lit("0%")).otherwise(F.format_string(f"%.{decimals}f%%", v))
