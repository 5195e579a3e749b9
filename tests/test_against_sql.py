"""Registered queries against their SQL at the smallest scale. SHELFCAST_ALL=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SHORT = [
    "dom1_sales_fact", "dom3_external_features", "win2_rolling_mean", "scl5_label_encode", "prj6_narrow_types",
    "dom5_safety_stock_lead_time", "dom6_reorder_points", "win11_seasonal_naive", "win14_half_means",
    "dom8_savings", "dom9_stockout_risk", "met1_forecaster_metrics", "met4_segment_metrics",
    "agg20_error_by_magnitude", "ens5_segment_weights", "ens8_spread_intervals", "ens10_comparison_table",
    "jn13_segment_weight_lookup", "win15_time_folds", "agg17_weekly_totals", "dom12_anomalies",
    "agg5_store_heatmap", "dom13_forecast_summary", "set5_compare_versions", "snk1_fact_parquet",
]
KEYS = list(queries()) if os.environ.get("SHELFCAST_ALL") else SHORT


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    assert compare(spark, con, FOLDER, key, queries()[key], oracle_sql().get(key)) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
