"""Edge cases of the sales fact and the feature groups."""

import datetime as dt

import pytest

from shelfcast.operators import etl
from shelfcast.operators import features as ft
from shelfcast.operators.learners import split_by_date

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_oil_gaps_fill_both_ways(spark):
    oil = spark.createDataFrame([(day(1), None), (day(2), 5.0), (day(5), 8.0), (day(6), None)], "date date, dcoilwtico double")
    got = {r.date: r.oil_price for r in etl.daily_oil_price(oil).collect()}
    assert got == {day(1): 5.0, day(2): 5.0, day(3): 5.0, day(4): 5.0, day(5): 8.0, day(6): 8.0}
    dates = spark.createDataFrame([(day(i),) for i in (0, 3, 9)], "date date")
    assert {r.date: r.oil_price for r in etl.oil_for_dates(dates, oil).collect()} == {day(0): 5.0, day(3): 5.0, day(9): 5.0}


def test_fact_keeps_every_sale(spark):
    raw = {
        "train": spark.createDataFrame([(day(0), 1, "A", -3.0, 2), (day(1), 9, "A", 4.0, 0)], "date date, store_nbr int, family string, sales double, onpromotion int"),
        "stores": spark.createDataFrame([(1, "c", "s", "t", 3)], "store_nbr int, city string, state string, store_type string, cluster int"),
        "oil": spark.createDataFrame([(day(0), 7.0)], "date date, dcoilwtico double"),
        "holidays": spark.createDataFrame(
            [(day(0), "Z", "L", False), (day(0), "A", "L", False), (day(1), "M", "L", True)],
            "date date, type string, locale string, transferred boolean"),
        "transactions": spark.createDataFrame([(day(0), 1, 11)], "date date, store_nbr int, transactions int"),
    }
    got = {r.store_nbr: r for r in etl.build_sales_fact(raw).collect()}
    assert len(got) == 2
    assert (got[1].sales, got[1].is_zero_sales, got[1].is_holiday, got[1].holiday_type, got[1].transactions) == (0.0, 1, 1, "A", 11)
    assert (got[9].sales, got[9].city, got[9].is_holiday, got[9].transactions, got[9].oil_price) == (4.0, None, 0, 0, 7.0)


def test_quality_row_counts_duplicates(spark):
    df = spark.createDataFrame(
        [(day(0), 1, "A", -1.0), (day(0), 1, "A", 2.0), (day(0), None, "A", 2.0), (day(1), 1, "A", 2.0)],
        "date date, store_nbr int, family string, sales double")
    r = etl.quality_row(df).first()
    assert (r.rows, r.null_keys, r.negative_sales, r.duplicate_keys) == (4, 1, 1, 1)


@pytest.mark.parametrize("low, high, kind", [(0, 127, "tinyint"), (-129, 0, "smallint"), (0, 40000, "int"), (0, 2**31, "bigint")])
def test_integer_width(spark, low, high, kind):
    df = spark.createDataFrame([(low, 1.0), (high, 2.0)], "n bigint, x double")
    assert dict(etl.narrow_types(df).dtypes) == {"n": kind, "x": "float"}


def test_no_holiday_at_all(spark):
    df = spark.createDataFrame([(day(i), 0) for i in range(10)], "date date, is_holiday int")
    for r in ft.holiday_features(df).collect():
        assert (r.days_since_holiday, r.days_to_holiday, r.is_holiday_week) == (60, 60, 0)


def test_holiday_distances(spark):
    flags = {3: 1, 8: 1}
    df = spark.createDataFrame([(day(i), flags.get(i, 0)) for i in range(10)], "date date, is_holiday int")
    got = {r.date: (r.days_since_holiday, r.days_to_holiday) for r in ft.holiday_features(df).collect()}
    assert got[day(0)] == (60, 3) and got[day(3)] == (0, 5) and got[day(7)] == (4, 1) and got[day(9)] == (1, 60)


def test_zero_means(spark):
    df = spark.createDataFrame([(day(i), 1, "A", 0, 0) for i in range(5)], "date date, store_nbr int, family string, onpromotion int, transactions int")
    for r in ft.add_external_features(df).collect():
        assert (r.promo_vs_store_avg, r.txn_vs_store_avg, r.has_promotion) == (0.0, 1.0, 0)


def test_oil_levels_of_three_dates(spark):
    df = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate((10, 20, 30))], "date date, oil_price double")
    got = {r.date: r.oil_price_level for r in ft.oil_features(df).collect()}
    assert got == {day(0): 0, day(1): 1, day(2): 2}  # cuts 16.6 and 23.2


def test_lags_need_full_history(spark):
    df = spark.createDataFrame([(day(i), s, "A", float(10 * s + i)) for s in (1, 2) for i in range(9)], "date date, store_nbr int, family string, sales double")
    got = {(r.store_nbr, r.date): r for r in ft.add_lag_features(df, [7], [7]).collect()}
    assert got[2, day(6)].sales_lag_7 is None and got[2, day(6)].sales_rolling_mean_7 is None
    assert got[2, day(7)].sales_lag_7 == 20.0 and got[2, day(7)].sales_rolling_mean_7 == 23.0


def test_smart_fill_and_codes(spark):
    df = spark.createDataFrame([("b", None), (None, 1.0), ("a", 2.0)], "city string, x double")
    coded = {r.city: r.city_encoded for r in ft.add_store_features(df).collect()}
    assert coded == {"a": 0, "b": 1, None: 2}
    assert sorted(map(tuple, ft.smart_fill(df).collect())) == [("None", 1.0), ("a", 2.0), ("b", 0.0)]


def test_split_by_date(spark):
    df = spark.createDataFrame([(day(i),) for i in range(10)], "date date")
    before, after = split_by_date(df, 3)
    assert (before.count(), after.count()) == (7, 3)


def test_etl_from_csv_to_features(spark):
    from checks.base import Tables
    from shelfcast.plans.etl import run_etl, run_features
    from shelfcast.sources import schemas, sinks
    from shelfcast.sources.storage import new_path

    raw = Tables(spark, "/root/testdata/sf0.001").raw
    folder = new_path(spark, "raw")
    for name, file in schemas.RAW_FILES.items():
        sinks.write_csv(raw[name], f"{folder}/{file}")
    fact = run_etl(spark, folder, folder)
    assert fact.count() == raw["train"].count()
    assert dict(fact.dtypes)["sales"] == "float" and fact.where("oil_price IS NULL").count() == 0
    features = run_features(fact, folder)
    assert features.count() == fact.count()
    assert {"sales_lag_28", "holiday_proximity", "city_encoded", "txn_vs_store_avg"} <= set(features.columns)
