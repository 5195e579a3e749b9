"""Raw tables -> one denormalised daily sales fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.fill import densify_daily, fill_both_ways, first_per_date


def clean_sales(train: DataFrame) -> DataFrame:
    """Negative sales become 0; zero sales are flagged after that."""
    clipped = F.when(F.col("sales").isNotNull(), F.greatest("sales", F.lit(0.0)))
    return train.withColumn("sales", clipped).withColumn(
        "is_zero_sales", F.coalesce((F.col("sales") == 0).cast("int"), F.lit(0))
    )


def daily_oil_price(oil: DataFrame) -> DataFrame:
    """Oil price of every day between the first and last quote, gaps filled both ways."""
    return densify_daily(oil).select("date", fill_both_ways("dcoilwtico").alias("oil_price"))


def effective_holidays(holidays: DataFrame, tiebreak: str = "ordinal") -> DataFrame:
    """One holiday per date among those not transferred. A table without the tiebreak column is
    taken in a stated order (type, locale) instead of file order."""
    kept = holidays.where(~F.col("transferred"))
    if tiebreak not in kept.columns:
        kept = kept.withColumn(tiebreak, F.struct("type", "locale"))
    kept = kept.select("date", F.col("type").alias("holiday_type"), "locale", tiebreak)
    return first_per_date(kept, tiebreak)


def oil_for_dates(dates: DataFrame, oil: DataFrame) -> DataFrame:
    """Oil price for the dates of the fact, filled in date order where quotes stop."""
    joined = dates.join(F.broadcast(daily_oil_price(oil)), "date", "left")
    return joined.select("date", fill_both_ways("oil_price").alias("oil_price"))


def build_sales_fact(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Sales with store attributes, oil price, holiday and transactions of the day. The oil and
    holiday tables have one row per day and are broadcast; stores and transactions are joined
    as their sizes allow."""
    train = clean_sales(raw["train"])
    dates = raw["train"].select("date").distinct()
    by_day = oil_for_dates(dates, raw["oil"]).join(
        F.broadcast(effective_holidays(raw["holidays"])), "date", "left"
    )
    return (
        train.join(raw["stores"], "store_nbr", "left")
        .join(F.broadcast(by_day), "date", "left")
        .join(raw["transactions"], ["date", "store_nbr"], "left")
        .select(
            *train.columns,
            *[c for c in raw["stores"].columns if c != "store_nbr"],
            "oil_price",
            "holiday_type",
            "locale",
            F.col("holiday_type").isNotNull().cast("int").alias("is_holiday"),
            F.coalesce("transactions", F.lit(0)).alias("transactions"),
        )
    )


def narrow_types(df: DataFrame, integers: Sequence[str] | None = None) -> DataFrame:
    """Doubles as float; 64-bit integers in the smallest width that holds their range, found by
    one min/max pass that returns a single row."""
    longs = list(integers) if integers is not None else [c for c, t in df.dtypes if t == "bigint"]
    widths = {}
    if longs:
        seen = df.agg(
            *[F.min(c).alias(f"lo_{c}") for c in longs], *[F.max(c).alias(f"hi_{c}") for c in longs]
        ).first()
        for c in longs:
            widths[c] = _integer_width(seen[f"lo_{c}"], seen[f"hi_{c}"])
    casts = []
    for c, t in df.dtypes:
        target = "float" if t == "double" else widths.get(c, t)
        casts.append(F.col(c) if target == t else F.col(c).cast(target).alias(c))
    return df.select(*casts)


def _integer_width(low: int | None, high: int | None) -> str:
    if low is None:
        return "bigint"
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        if -(2**bits) <= low and high < 2**bits:
            return name
    return "bigint"


def quality_row(df: DataFrame, keys: Sequence[str] = ("date", "store_nbr", "family")) -> DataFrame:
    """One row of data-quality counts: rows, rows with a NULL key, negative sales, and key
    combinations that occur more than once. One shuffle, pre-aggregated by key."""
    keys = list(keys)
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sales") < 0).alias("negative")
    )
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_sales"),
        F.count_if((F.col("n") > 1) & ~null_key).alias("duplicate_keys"),
    )
