"""Forecast fact -> safety stock, orders, savings, risk and summary."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import finance as fin
from shelfcast.operators.reorder import ReorderSettings, reorder_plan
from shelfcast.operators.safety_stock import SafetyStockSettings, safety_stock
from shelfcast.sources.storage import stage


def optimize_inventory(
    forecasts: DataFrame,
    segment_col: str = "store_nbr",
    actual_col: str = "sales",
    forecast_col: str = "forecast_ensemble",
    service_levels: Mapping | DataFrame | None = None,
    order: tuple[str, ...] = ("date", "family"),
    stock_settings: SafetyStockSettings = SafetyStockSettings(),
    reorder_settings: ReorderSettings = ReorderSettings(),
    finance_settings: fin.FinanceSettings = fin.FinanceSettings(),
    keep: Callable[[DataFrame, str], DataFrame] = stage,
) -> dict[str, DataFrame]:
    """All inventory outputs. The segment, method and risk tables are each computed once and
    kept (by default in the shared folder); everything after them reads those small tables.
    The forecasts are read by each of the three, so pass a stored table."""
    stock = keep(
        safety_stock(
            forecasts, segment_col, actual_col, forecast_col, "forecast_error", service_levels, stock_settings
        ),
        "safety_stock",
    )
    inventory = reorder_plan(stock, settings=reorder_settings)
    global_mean = forecasts.agg(F.avg(actual_col)).scalar()
    slim = forecasts.select(segment_col, *order, actual_col, forecast_col)
    baselines = fin.seasonal_naive(slim, segment_col, actual_col, order)
    comparison = keep(
        fin.compare_methods(
            baselines,
            {fin.AI: forecast_col, fin.NAIVE: global_mean, fin.SEASONAL: "seasonal_naive"},
            actual_col,
            settings=finance_settings,
        ),
        "comparison",
    )
    saved = fin.savings(comparison, settings=finance_settings)
    risk = keep(
        fin.stockout_risk(forecasts, stock, forecast_col, segment_col, order, finance_settings),
        "stockout_risk",
    )
    summary = fin.executive_summary(saved, risk, inventory)
    return {
        "safety_stock": stock,
        "inventory": inventory,
        "comparison": comparison,
        "savings": saved,
        "risk": risk,
        "executive_summary": summary,
        "document": financial_document(comparison, saved, summary),
    }


def financial_document(comparison: DataFrame, saved: DataFrame, summary: DataFrame) -> DataFrame:
    """One nested row: comparison by method, savings, executive summary."""
    by_method = comparison.agg(
        F.map_from_entries(F.collect_list(F.struct("method", F.struct(*fin.MEASURES))))
    ).scalar()
    saved_struct = saved.select(F.struct(*saved.columns)).scalar()
    return summary.select(
        by_method.alias("comparison"),
        saved_struct.alias("savings"),
        F.struct(*summary.columns).alias("executive_summary"),
    )
