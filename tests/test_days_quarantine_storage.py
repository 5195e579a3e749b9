"""Day frames, averages of the past, quarantine, bucketed storage and anomaly levels against plain versions."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import anomaly, day_frames, features
from shelfcast.sources import quarantine, sinks
from shelfcast.sources.storage import new_path, stage

D0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def gaps():
    draw = random.Random(3)
    return [(D0 + dt.timedelta(days=i), s, "f", float(draw.randrange(50)), draw.randrange(4)) for s in (1, 2, None) for i in range(0, 90) if draw.random() < 0.6]


@pytest.fixture(scope="module")
def frame(spark, gaps):
    return spark.createDataFrame(gaps, "date date, store_nbr int, family string, sales double, onpromotion int")


@pytest.mark.parametrize("block", [28, 31, 365])
def test_day_lags_go_by_the_calendar(frame, gaps, block):
    got = {(r.store_nbr, r.date): r for r in day_frames.add_day_lags(frame, block_days=block).collect()}
    known = {(s, d): v for d, s, _, v, _ in gaps}
    assert len(got) == len(gaps)
    for (s, d), r in got.items():
        for k in (7, 14, 28):
            assert r[f"sales_day_lag_{k}"] == known.get((s, d - dt.timedelta(days=k)))
        for k in (7, 28):
            past = [known[s, d - dt.timedelta(days=i)] for i in range(1, k + 1) if (s, d - dt.timedelta(days=i)) in known]
            assert r[f"sales_day_mean_{k}"] == (pytest.approx(statistics.mean(past)) if past else None)


def test_day_lags_of_undated_rows_and_wrong_reach(spark):
    rows = spark.createDataFrame([(None, 1, "f", 2.0), (D0, 1, "f", 3.0)], "date date, store_nbr int, family string, sales double")
    got = day_frames.add_day_lags(rows).collect()
    assert len(got) == 2 and all(r.sales_day_lag_7 is None and r.sales_day_mean_7 is None for r in got)
    with pytest.raises(ValueError):
        day_frames.add_day_lags(rows, lags=(40,), block_days=28)


def test_no_ratio_knows_its_own_or_a_later_day(frame, gaps):
    cut = D0 + dt.timedelta(days=40)
    for cutoff in (None, F.lit(cut)):
        for r in day_frames.add_ratios_to_the_past(frame, cutoff=cutoff).collect():
            past = [p for d, s, _, _, p in gaps if s == r.store_nbr and d < r.date and (cutoff is None or d <= cut)]
            mean = statistics.mean(past) if past else 0
            assert r.promo_vs_store_past == pytest.approx(min(r.onpromotion / mean, 10) if mean else 0)


def test_bad_rows_are_set_aside_with_their_reasons(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "date,store_nbr,family,sales,onpromotion,extra\n2024-01-01,1,A,2.5,0,x\n2024-13-01,1,A,2.5,0,x\n2024-01-02,one,A,many,0,x\n"
        '2024-01-03,2,"B, C",,1,x\n2024-01-04,3\n2024-01-05,3,D,1,0,x,y\n,,,,,\n'
    )
    got = quarantine.read_checked(spark, str(tmp_path / "train.csv"), "date date, store_nbr int, family string, sales double, onpromotion int, gone int", new_path(spark, "q"))
    assert (got.total, got.n_good, got.n_bad) == (7, 3, 4)
    assert got.good.columns == ["date", "store_nbr", "family", "sales", "onpromotion"]
    assert {(str(r.date), r.family, r.sales) for r in got.good.collect()} == {("2024-01-01", "A", 2.5), ("2024-01-03", "B, C", None), ("None", None, None)}
    assert sorted(tuple(r.reasons) for r in got.bad.collect()) == [
        ("date is no date",), ("number of cells",), ("number of cells",), ("store_nbr is no int", "sales is no double"),
    ]
    assert all("train.csv" in r.file for r in got.bad.collect())


def test_series_windows_over_bucketed_storage_need_no_exchange(spark, frame):
    path = new_path(spark, "bucketed")
    table = "bucketed_" + path.split("/")[-2]
    rows = stage(frame.withColumn("date", F.when(F.col("store_nbr") == 2, F.add_months("date", 12)).otherwise(F.col("date"))), "rows")
    sinks.write_bucketed(rows, table, path, buckets=4)
    lagged = features.add_lag_features(spark.table(table))
    assert "Exchange" not in lagged._jdf.queryExecution().executedPlan().toString()
    assert lagged.count() == rows.count()
    files = {f: sinks_time for f, sinks_time in _files(path)}
    sinks.overwrite_years(rows.where("year(date) = 2025").withColumn("sales", F.lit(7.0)), table)
    after = dict(_files(path))
    assert {f for f in files if "year=2024" in f} == {f for f in after if "year=2024" in f and after[f] == files.get(f)}
    assert not {f for f in files if "year=2025" in f} & set(after)
    spark.catalog.refreshTable(table)
    assert spark.table(table).where("year = 2025 and sales <> 7").count() == 0 and spark.table(table).count() == rows.count()
    assert "Exchange" not in features.add_lag_features(spark.table(table))._jdf.queryExecution().executedPlan().toString()


def _files(path):
    import pathlib

    return [(str(p), p.stat().st_mtime_ns) for p in pathlib.Path(path.removeprefix("file:")).rglob("part-*")]


def test_anomaly_levels_against_a_plain_version(spark):
    draw = random.Random(8)
    rows = [(s, f, D0 + dt.timedelta(days=i), draw.gauss(100, 5 + 30 * (f == "B")) * (3 if draw.random() < 0.02 else 1), 100.0) for s in (1, 2, None) for f, n in (("A", 60), ("B", 35), ("C", 4)) for i in range(n)]
    rows += [(1, "C", D0 + dt.timedelta(days=50), 400.0, 100.0), (9, "A", D0, 500.0, 100.0), (9, "A", D0, None, 100.0)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double, forecast_ensemble double")
    levels = [["store_nbr", "family"], ["store_nbr"]]
    got = anomaly.detect_anomalies(df, segment_cols=["store_nbr", "family"], levels=levels, min_samples=30, pct_threshold=9.0, z_threshold=2.0).collect()
    want = []
    for s, f, d, v, p in rows:
        if v is None:
            continue
        own = [x[3] - x[4] for x in rows if (x[0], x[1]) == (s, f) and x[3] is not None]
        store = [x[3] - x[4] for x in rows if x[0] == s and x[3] is not None]
        name, base = ("store_nbr, family", own) if len(own) >= 30 else ("store_nbr", store) if len(store) >= 30 else ("all", [x[3] - x[4] for x in rows if x[3] is not None])
        z = (v - p - statistics.mean(base)) / statistics.stdev(base)
        if abs(z) > 2:
            want.append((s, f, d, name, len(base), round(min(abs(v - p) / p * 100 + abs(z) * 10, 100.0), 6)))
    assert sorted(map(str, [(r.store_nbr, r.family, r.date, r.baseline, r.baseline_n, round(r.severity, 6)) for r in got])) == sorted(map(str, want))
    assert {w[3] for w in want} == {"store_nbr, family", "store_nbr", "all"}
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(df, levels=[["store_nbr"], ["family"]])
