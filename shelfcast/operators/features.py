"""Feature groups over the sales fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.scalar import clip, ratio
from shelfcast.operators.fill import calendar_order, fill_both_ways
from shelfcast.operators.joins import null_safe_join
from shelfcast.operators.ordinal import with_global_position
from shelfcast.sources.storage import stage

NO_HOLIDAY_DAYS = 60
OIL_FEATURES = [
    "oil_price_lag_7",
    "oil_price_ma_14",
    "oil_price_change_7",
    "oil_price_volatility_14",
    "oil_price_level",
]
HOLIDAY_FEATURES = [
    "days_since_holiday",
    "days_to_holiday",
    "holiday_proximity",
    "is_holiday_eve",
    "is_post_holiday",
    "is_holiday_week",
]


def add_time_features(df: DataFrame) -> DataFrame:
    """Calendar parts; day_of_week counts from Monday = 0."""
    return df.withColumns(
        {
            "day_of_week": F.weekday("date"),
            "month": F.month("date"),
            "year": F.year("date"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
            "is_payday": F.dayofmonth("date").isin(15, 30, 31).cast("int"),
        }
    )


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct combinations of some text columns, as _label_<column>, with each text's rank
    among the sorted distinct texts of its column, from 0, as <column>_encoded. A missing text
    is ranked as a text of its own."""
    labels = {c: f"_label_{c}" for c in columns}
    combos = stage(df.select(*[_label(c).alias(k) for c, k in labels.items()]).distinct(), "labels")
    for c, k in labels.items():
        codes = with_global_position(combos.select(k).distinct(), [k], f"{c}_encoded")
        combos = combos.join(codes.withColumn(f"{c}_encoded", F.col(f"{c}_encoded").cast("int")), k)
    return combos


def _label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def add_store_features(
    df: DataFrame,
    columns: Sequence[str] = ("city", "state", "store_type"),
    source: DataFrame | None = None,
) -> DataFrame:
    """Label codes of the text columns present. `source` is the table to take the labels from;
    give the stored fact when df has grown columns that need not be computed for it."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    keyed = df.withColumns({f"_label_{c}": _label(c) for c in present})
    codes = label_codes(df if source is None else source, present)
    keys = [f"_label_{c}" for c in present]
    return keyed.join(codes, keys, "left").drop(*keys)


def date_features(df: DataFrame) -> DataFrame:
    """Oil and holiday features per distinct date, each group where its column exists: one scan
    of the fact, then windows over a table with one row per day."""
    inputs = {
        "oil_price": F.first("oil_price", ignorenulls=True),
        "is_holiday": F.max("is_holiday"),
    }
    present = [c for c in inputs if c in df.columns]
    days = df.groupBy("date").agg(*[inputs[c].alias(c) for c in present])
    if "oil_price" in present:
        days = _oil_columns(days)
    if "is_holiday" in present:
        days = _holiday_columns(days)
    return days.drop(*present)


def oil_features(df: DataFrame) -> DataFrame:
    return date_features(df.select("date", "oil_price"))


def holiday_features(df: DataFrame) -> DataFrame:
    return date_features(df.select("date", "is_holiday"))


def _oil_columns(days: DataFrame) -> DataFrame:
    w = calendar_order()
    trailing = w.rowsBetween(-13, 0)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    price, before = F.col("oil_price"), F.lag("oil_price", 7).over(w)
    change = ratio(price - before, before, 0.0)
    cuts = F.percentile("oil_price", F.array(F.lit(0.33), F.lit(0.66))).over(everything)
    raw = days.withColumns(
        {
            "_cuts": cuts,
            "oil_price_lag_7": before,
            "oil_price_ma_14": F.avg("oil_price").over(trailing),
            "oil_price_change_7": clip(change, -0.5, 0.5),
            "oil_price_volatility_14": F.coalesce(
                F.stddev_samp("oil_price").over(trailing), F.lit(0.0)
            ),
        }
    ).withColumn(
        "oil_price_level",
        F.when(price <= F.col("_cuts")[0], 0).when(price <= F.col("_cuts")[1], 1).when(price.isNotNull(), 2),
    )
    return raw.withColumns({c: fill_both_ways(c) for c in OIL_FEATURES}).drop("_cuts")


def _holiday_columns(days: DataFrame) -> DataFrame:
    """Distance to the last holiday on or before the date and to the next one after it."""
    w = calendar_order()
    holiday = F.when(F.col("is_holiday") == 1, F.col("date"))
    last = F.max(holiday).over(w.rowsBetween(Window.unboundedPreceding, 0))
    upcoming = F.min(holiday).over(w.rowsBetween(1, Window.unboundedFollowing))
    far = F.lit(NO_HOLIDAY_DAYS)
    since, to = F.col("days_since_holiday"), F.col("days_to_holiday")
    return days.withColumns(
        {
            "days_since_holiday": F.least(F.coalesce(F.datediff("date", last), far), far),
            "days_to_holiday": F.least(F.coalesce(F.datediff(upcoming, "date"), far), far),
        }
    ).withColumns(
        {
            "holiday_proximity": 1.0 / (1.0 + F.least(since, to)),
            "is_holiday_eve": (to == 1).cast("int"),
            "is_post_holiday": (since == 1).cast("int"),
            "is_holiday_week": ((since <= 3) | (to <= 3)).cast("int"),
        }
    )


def _with_store_means(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Join each store's mean of the given columns, over all its dates, as _mean_<column>."""
    means = (df if source is None else source).groupBy("store_nbr").agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return null_safe_join(df, means, ["store_nbr"])


def add_store_day_totals(df: DataFrame) -> DataFrame:
    """Promotions of the store on the day; such a group holds one row per family."""
    per_day = Window.partitionBy("date", "store_nbr")
    return df.withColumn("store_total_promotions", F.sum("onpromotion").over(per_day).cast("double"))


def _promotion_columns(df: DataFrame) -> DataFrame:
    if "store_total_promotions" not in df.columns:
        df = add_store_day_totals(df)
    return df.withColumns(
        {
            "has_promotion": (F.col("onpromotion") > 0).cast("int"),
            "log_onpromotion": F.log1p("onpromotion"),
            "promo_vs_store_avg": clip(
                ratio(F.col("onpromotion"), F.col("_mean_onpromotion"), 0.0), 0.0, 10.0
            ),
        }
    ).drop("_mean_onpromotion")


def _transaction_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_transactions": F.log1p("transactions"),
            "txn_vs_store_avg": clip(
                ratio(F.col("transactions"), F.col("_mean_transactions"), 1.0), 0.0, 5.0
            ),
        }
    ).drop("_mean_transactions")


def add_promotion_features(df: DataFrame) -> DataFrame:
    """Promotion flags, the store's total on the day and the row against the store's mean."""
    return _promotion_columns(_with_store_means(df, ["onpromotion"]))


def add_transaction_features(df: DataFrame) -> DataFrame:
    return _transaction_columns(_with_store_means(df, ["transactions"]))


def add_external_features(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Oil, holiday, promotion and transaction groups, each where its input column exists. The
    date features are joined as one broadcast table with a row per day. `source` is the
    table the date and store tables are taken from, by default df itself."""
    source = df if source is None else source
    if "oil_price" in df.columns or "is_holiday" in df.columns:
        df = df.join(F.broadcast(date_features(source)), "date", "left")
    counted = [c for c in ("onpromotion", "transactions") if c in df.columns]
    if counted:
        df = _with_store_means(df, counted, source)
    if "onpromotion" in counted:
        df = _promotion_columns(df)
    if "transactions" in counted:
        df = _transaction_columns(df)
    return df


def add_lag_features(
    df: DataFrame, lags: Sequence[int] = (7, 14, 28), windows: Sequence[int] = (7, 28)
) -> DataFrame:
    """Row lags and means of the previous rows within a (store, family) series. A series has one
    row per day, so its window is bounded by the calendar."""
    w = Window.partitionBy("store_nbr", "family").orderBy("date")
    new = {f"sales_lag_{k}": F.lag("sales", k).over(w) for k in lags}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        full = F.count("sales").over(frame) == k
        new[f"sales_rolling_mean_{k}"] = F.when(full, F.avg("sales").over(frame))
    return df.withColumns(new)


def smart_fill(df: DataFrame) -> DataFrame:
    """NULL numbers become 0 and NULL texts "None"."""
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.na.fill(0).na.fill("None", texts)
