"""Edge cases and identities of stock, orders, cost, risk and anomalies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import anomaly as an
from shelfcast.operators import finance as fin
from shelfcast.operators import serving as sv
from shelfcast.operators.reorder import ReorderSettings, economic_order_quantity, reorder_plan
from shelfcast.operators.safety_stock import SafetyStockSettings, safety_stock
from shelfcast.plans.optimize import optimize_inventory

SCHEMA = "date date, store_nbr int, family string, sales double, forecast_ensemble double, forecast_lower double, forecast_upper double"
SIZES = {1: 4, 2: 6, 3: 7, 4: 9, 5: 10}


def frame(spark, rows):
    full = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), s, f, a, p, p - 1, p + 1) for i, s, f, a, p in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, s, "A", 10.0 + i + s, 11.0 + 2 * i) for s, n in SIZES.items() for i in range(n)]
    return frame(spark, rows)


def test_eoq_worked_example(spark):
    assert spark.range(1).select(economic_order_quantity(F.lit(73000.0), 50.0, 2.5)).first()[0] == 1709.0
    assert spark.range(1).select(economic_order_quantity(F.lit(0.0), 50.0, 2.5)).first()[0] == 0.0
    assert spark.range(1).select(economic_order_quantity(F.lit(5.0), 50.0, 0.0)).first()[0] == 0.0


def test_all_actuals_zero(spark):
    df = frame(spark, [(i, 1, "A", 0.0, 2.0) for i in range(8)])
    ss = safety_stock(df).first()
    assert (ss.forecast_mape, ss.safety_stock_days) == (0.0, 0.0)
    plan = reorder_plan(safety_stock(df)).first()
    assert (plan.eoq, plan.total_cost, plan.n_orders_per_year, plan.days_of_supply) == (0.0, 0.0, None, None)
    assert fin.compare_methods(df, {fin.AI: "forecast_ensemble"}).first().mape == 1.0


def test_bad_arguments(sized):
    with pytest.raises(ValueError):
        safety_stock(sized, method="other")
    with pytest.raises(ValueError):
        SafetyStockSettings(service_level=0.4)
    with pytest.raises(ValueError):
        sv.forecast_request(sized, horizon_days=91)


def test_service_levels_by_mapping_and_table(spark, sized):
    table = spark.createDataFrame([(2, 0.99)], "segment int, service_level double")
    by_map = {r.segment: (r.z_score, r.safety_stock) for r in safety_stock(sized, service_levels={2: 0.99}).collect()}
    by_table = {r.segment: (r.z_score, r.safety_stock) for r in safety_stock(sized, service_levels=table).collect()}
    assert by_map == by_table and by_map[2][0] == 2.326 and by_map[1][0] == 1.645


def test_trend_risk_of_short_segments(sized):
    got = {r.segment: r for r in fin.stockout_risk(sized, safety_stock(sized)).collect()}
    assert [got[s].trend_risk for s in (1, 2)] == [50.0, 50.0]
    assert got[1].demand_trend_pct == 0.0 and got[3].trend_risk == 100.0


def test_half_means_match_positions(spark):
    rows = [(i // 3, 1 if i % 4 else 2, f"f{i % 3}{i}", float(i), float((i * 7) % 11)) for i in range(41)]
    df = frame(spark, rows)
    got = {r.segment: r for r in fin.half_means(df).collect()}
    for s in (1, 2):
        mine = [p for _, _, p in sorted((d, f, p) for d, st, f, _, p in rows if st == s)]
        half = len(mine) // 2
        assert got[s].n_rows == len(mine)
        assert got[s].first_half == pytest.approx(sum(mine[:half]) / half)
        assert got[s].second_half == pytest.approx(sum(mine[half:]) / (len(mine) - half))


def test_half_of_a_single_row(spark):
    r = fin.half_means(frame(spark, [(0, 1, "A", 1.0, 3.0)])).first()
    assert (r.n_rows, r.first_half, r.second_half) == (1, None, 3.0)


def test_cost_identities(sized):
    methods = {fin.AI: "forecast_ensemble", fin.NAIVE: F.lit(15.0)}
    comparison = fin.compare_methods(sized, methods)
    rows = {r.method: r for r in comparison.collect()}
    n = sum(SIZES.values())
    for r in rows.values():
        assert r.stockout_cost == pytest.approx(r.total_under_forecast_units * 5 * 1.5)
        assert r.excess_inventory_cost == pytest.approx(r.total_over_forecast_units * 10 * 0.25 / 365 * n)
        assert r.total_cost_of_errors == pytest.approx(r.excess_inventory_cost + r.stockout_cost)
    sums = sized.agg(F.sum(F.col("forecast_ensemble") - F.col("sales"))).first()[0]
    ai = rows[fin.AI]
    assert ai.total_over_forecast_units - ai.total_under_forecast_units == pytest.approx(sums)
    s = fin.savings(comparison).first()
    assert s.working_capital_freed == pytest.approx(s.excess_inventory_reduction_units * 10)
    assert s.working_capital_cost_saved == pytest.approx(s.working_capital_freed * 0.08)
    assert s.annualized_savings_estimate == pytest.approx(s.total_direct_savings * 365 / 16)


def test_optimize_outputs(sized):
    out = optimize_inventory(sized)
    doc = out["document"].first()
    assert set(doc["comparison"]) == {fin.AI, fin.NAIVE, fin.SEASONAL}
    top = doc["executive_summary"]["risk_summary"]["top_risk_segments"]
    scores = [t["composite_risk_score"] for t in top]
    assert len(top) == 5 and scores == sorted(scores, reverse=True)
    assert doc["executive_summary"]["recommendations"][-1]["priority"] == "MEDIUM"


def test_eoq_grows_with_demand(spark):
    df = spark.range(1, 200).select(economic_order_quantity(F.col("id") * 10.0, 50.0, 2.5).alias("q"), "id")
    q = [r.q for r in df.orderBy("id").collect()]
    assert q == sorted(q) and min(q) >= 1


def test_spike_is_found(spark):
    rows = [(i, 1, "A", 10.0 + (i % 3), 10.0) for i in range(29)] + [(29, 1, "A", 30.0, 10.0)]
    found = an.detect_anomalies(frame(spark, rows), segment_cols=["store_nbr", "absent"]).collect()
    assert [(r.anomaly_type, r.severity) for r in found] == [("Spike", 100.0)]


def test_constant_residual_uses_the_percentage_only(spark):
    df = frame(spark, [(i, 1, "A", 2.0 + f, f) for i, f in enumerate((1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0))])
    found = an.detect_anomalies(df).collect()
    assert sorted(r.forecast_ensemble for r in found) == [1.0, 2.0, 3.0]
    assert all(r.severity <= 100 for r in found)


def test_no_anomaly_summary(spark):
    df = frame(spark, [(i, 1, "A", 10.0, 10.0) for i in range(5)])
    assert tuple(an.anomaly_summary(an.detect_anomalies(df)).first()) == (0, 0, 0, 0.0, 0.0)


def test_anomaly_text(spark):
    df = frame(spark, [(0, 3, "A", 30.0, 10.0)])
    r = an.describe(df).first()
    assert (r.deviation_pct, r.direction) == (200.0, "higher")
    assert r.description.endswith("Deviation: +200.0% (higher than expected)")


def test_filters_and_columns(sized):
    assert sv.apply_filters(sized).count() == sum(SIZES.values())
    some = sv.apply_filters(sized, dt.date(2020, 1, 2), dt.date(2020, 1, 3), [1, 5], ["A"])
    assert some.count() == 4
    assert sv.forecast_column(sized, "prophet") == "forecast_ensemble"
    with pytest.raises(ValueError):
        sv.forecast_column(sized.select("date"), "prophet")


def test_forecast_request_limits(sized):
    rows, summary = sv.forecast_request(sized, horizon_days=1, store_ids=[5])
    days = sized.where("store_nbr = 5").select("date").distinct().count()
    assert rows.count() == summary.first().forecast_count == sized.where("store_nbr = 5").count() // days
    assert sv.response_rows(sized, "forecast_ensemble").count() == sized.count()
    assert sv.response_rows(sized, "forecast_ensemble", limit=3).count() == 3
    _, none = sv.forecast_request(sized, store_ids=[-1])
    assert none.count() == 0
    assert summary.first().confidence_level == 0.95
    _, plain = sv.forecast_request(sized, include_intervals=False)
    assert "avg_lower" not in plain.columns


def test_risk_categories_without_rows(spark):
    risk = spark.createDataFrame([("HIGH", 80.0), ("HIGH", 90.0)], "risk_category string, composite_risk_score double")
    got = {r.risk_category: (r.segments, r.avg_score) for r in sv.risk_by_category(risk).collect()}
    assert got == {"HIGH": (2, 85.0), "MEDIUM": (0, 0.0), "LOW": (0, 0.0)}


def test_settings_hold_cost():
    assert ReorderSettings().holding_cost == 2.5


def test_the_null_segment_keeps_its_risk(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), s, "f", 20.0 + i % 3, 21.0) for s, n in ((1, 20), (None, 20), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, forecast_ensemble double")
    got = {r.segment: r.trend_known for r in fin.stockout_risk(df, safety_stock(df)).collect()}
    assert got == {1: True, None: True, 2: False}
