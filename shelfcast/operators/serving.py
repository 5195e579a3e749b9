"""The reads behind forecasts, inventory and dashboard requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import money
from shelfcast.operators.finance import stockout_risk
from shelfcast.operators.reorder import ReorderSettings, reorder_plan
from shelfcast.operators.safety_stock import SafetyStockSettings, safety_stock
from shelfcast.sources.storage import stage

# Model names and their columns, labels.
FORECAST_COLUMNS = {
    "ensemble": "forecast_ensemble",
    "xgboost": "forecast_xgboost",
    "random_forest": "forecast_rf",
    "prophet": "forecast_prophet",
}
CONFIDENCE = 0.95
RISK_LABELS = ("HIGH", "MEDIUM", "LOW")
WATERFALL = [
    ("Holding Cost Savings", "holding_cost_savings", "relative"),
    ("Stockout Cost Savings", "stockout_cost_savings", "relative"),
    ("Capital Cost Saved", "working_capital_cost_saved", "relative"),
    ("Total Annual Savings", "annualized_savings_estimate", "total"),
]
ROW_ORDER = ("date", "store_nbr", "family")


def apply_filters(
    df: DataFrame,
    date_start: dt.date | None = None,
    date_end: dt.date | None = None,
    stores: Sequence[int] = (),
    families: Sequence[str] = (),
) -> DataFrame:
    """Date range (inclusive), stores and families; an empty choice does not filter. Columns
    are compared as stored, so the filters reach the files."""
    if date_start is not None and "date" in df.columns:
        df = df.where(F.col("date") >= F.lit(date_start))
    if date_end is not None and "date" in df.columns:
        df = df.where(F.col("date") <= F.lit(date_end))
    if stores and "store_nbr" in df.columns:
        df = df.where(F.col("store_nbr").isin(list(stores)))
    if families and "family" in df.columns:
        df = df.where(F.col("family").isin(list(families)))
    return df


def filter_options(df: DataFrame) -> dict[str, DataFrame]:
    """Choices a filter offers: date range, sorted stores, sorted families."""
    return {
        "dates": df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date")),
        "stores": df.select("store_nbr").distinct().orderBy("store_nbr"),
        "families": df.select("family").distinct().orderBy("family"),
    }


def forecast_column(df: DataFrame, model: str) -> str:
    """Column of a model; if absent, the first model column there is."""
    wanted = FORECAST_COLUMNS.get(model, "forecast_ensemble")
    for c in (wanted, *FORECAST_COLUMNS.values()):
        if c in df.columns:
            return c
    raise ValueError(f"the table has no forecast column for {model!r}, only {df.columns}")


def within_horizon(df: DataFrame, horizon_days: int) -> DataFrame:
    """Rows of the first `horizon_days` calendar days of the table."""
    return df.where(F.col("date") < F.date_add(df.agg(F.min("date")).scalar(), horizon_days))


def response_rows(df: DataFrame, forecast_col: str, horizon_days: int | None = None, limit: int | None = None) -> DataFrame:
    """The rows a forecast request returns, in date, store, family order: those of the horizon, all of
    them unless a page size is given as `limit`."""
    order = [c for c in ROW_ORDER if c in df.columns]
    columns = [
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("store_nbr").cast("int").alias("store_nbr"),
        F.round(forecast_col, 2).alias("predicted_sales"),
        F.round("sales", 2).alias("actual_sales"),
    ]
    if "family" in df.columns:
        columns.append(F.col("family").cast("string").alias("category"))
    chosen = df if horizon_days is None else within_horizon(df, horizon_days)
    ordered = chosen.orderBy(*order)
    return (ordered if limit is None else ordered.limit(limit)).select(*columns)


def response_totals(df: DataFrame, forecast_col: str) -> DataFrame:
    """Total, mean of the daily totals, date range and distinct stores and categories."""
    daily = df.groupBy("date").agg(F.sum(forecast_col).alias("_day"))
    families = F.countDistinct("family") if "family" in df.columns else F.lit(0).cast("bigint")
    spread = df.agg(F.struct(F.countDistinct("store_nbr").alias("s"), families.alias("f"))).scalar()
    return daily.agg(
        F.round(F.sum("_day"), 2).alias("total_forecasted_sales"),
        F.round(F.avg("_day"), 2).alias("avg_daily_forecast"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    ).select(
        "*", spread["s"].alias("stores_included"), spread["f"].alias("categories_included")
    )


def interval_summary(df: DataFrame, lower: str = "forecast_lower", upper: str = "forecast_upper") -> DataFrame:
    return df.agg(
        F.lit(CONFIDENCE).alias("confidence_level"),
        F.round(F.avg(lower), 2).alias("avg_lower"),
        F.round(F.avg(upper), 2).alias("avg_upper"),
        F.round(F.avg(F.col(upper) - F.col(lower)), 2).alias("avg_width"),
    )


def forecast_request(
    df: DataFrame,
    store_ids: Sequence[int] = (),
    categories: Sequence[str] = (),
    horizon_days: int = 16,
    model: str = "ensemble",
    include_intervals: bool = True,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A forecast request: the response rows, and one summary row over all rows of the horizon.
    An empty selection gives no rows and no summary."""
    if not 1 <= horizon_days <= 90:
        raise ValueError("horizon_days must lie in 1..90")
    chosen = within_horizon(apply_filters(df, stores=store_ids, families=categories), horizon_days)
    c = forecast_column(df, model)
    rows = response_rows(chosen, c, limit=limit)
    counted = chosen.agg(F.count(F.lit(1))).scalar()
    summary = response_totals(chosen, c).select(F.lit(model).alias("model_used"), counted.alias("forecast_count"), "*")
    summary = summary.where(F.col("forecast_count") > 0)
    if include_intervals and {"forecast_lower", "forecast_upper"} <= set(df.columns):
        bounds = interval_summary(chosen)
        s = bounds.select(F.struct(*bounds.columns)).scalar()
        summary = summary.select("*", *[s[k].alias(k) for k in bounds.columns])
    return rows, summary


def forecast_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, stores and date range of the forecast table."""
    distinct = F.approx_count_distinct("store_nbr") if approximate else F.countDistinct("store_nbr")
    return df.agg(
        F.count(F.lit(1)).alias("forecast_rows"),
        distinct.alias("forecast_stores"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def restrict_segments(df: DataFrame, segments: Sequence) -> DataFrame:
    return df.where(F.col("segment").isin(list(segments))) if segments else df


def risk_summary(risk: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("risk_category") == label).alias(f"{label.lower()}_risk") for label in RISK_LABELS
    ]
    return risk.agg(
        F.count(F.lit(1)).alias("total_segments"),
        *counts,
        F.round(F.coalesce(F.sum("weekly_revenue_at_risk"), F.lit(0.0)), 2).alias("total_weekly_exposure"),
        F.round(F.avg("composite_risk_score"), 2).alias("avg_risk_score"),
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("segments_optimized"),
        F.round(F.coalesce(F.sum("safety_stock"), F.lit(0.0)), 2).alias("total_safety_stock"),
        F.round(F.coalesce(F.sum("holding_cost"), F.lit(0.0)), 2).alias("total_annual_holding_cost"),
    )


def optimize_request(
    forecasts: DataFrame,
    store_ids: Sequence[int] = (),
    service_level: float = 0.95,
    lead_time_days: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """An inventory request, computed with the requested service level and lead time: the
    recommendations and one row of totals and risk counts. Only the requested stores are
    read."""
    chosen = stage(apply_filters(forecasts, stores=store_ids), "requested_stores")
    settings = SafetyStockSettings(service_level, lead_time_days)
    stock = safety_stock(chosen, settings=settings)
    inventory = reorder_plan(stock, settings=ReorderSettings(lead_time_days=lead_time_days))
    totals = inventory_totals(inventory)
    risks = risk_summary(stockout_risk(chosen, stock))
    s = risks.select(F.struct(*risks.columns)).scalar()
    return inventory, totals.select("*", *[s[c].alias(c) for c in risks.columns])


def forecast_kpis(df: DataFrame, forecast_col: str) -> DataFrame:
    actual, forecast = F.sum("sales"), F.sum(forecast_col)
    error = F.when(actual > 0, F.abs(actual - forecast) / actual * 100).otherwise(0.0)
    return df.agg(
        actual.alias("actual_sales"),
        forecast.alias("forecasted_sales"),
        error.alias("error_pct"),
        F.count(F.lit(1)).alias("records"),
    )


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.avg("inventory_turnover").alias("avg_turnover"),
        F.avg("days_of_supply").alias("avg_days_of_supply"),
        F.sum("holding_cost").alias("total_holding_cost"),
        F.sum("safety_stock_cost").alias("total_safety_stock_cost"),
    )


def risk_by_category(risk: DataFrame) -> DataFrame:
    """Segments and mean score per category, all three categories present, 0 if empty."""
    def of(label: str) -> Column:
        return F.col("risk_category") == label

    rows = [
        F.struct(
            F.lit(label).alias("risk_category"),
            F.col(f"n_{label}").alias("segments"),
            F.col(f"s_{label}").alias("avg_score"),
        )
        for label in RISK_LABELS
    ]
    aggs = [F.count_if(of(x)).alias(f"n_{x}") for x in RISK_LABELS]
    aggs += [
        F.coalesce(F.avg(F.when(of(x), F.col("composite_risk_score"))), F.lit(0.0)).alias(f"s_{x}")
        for x in RISK_LABELS
    ]
    return risk.agg(*aggs).select(F.inline(F.array(*rows)))


def daily_series(
    df: DataFrame,
    actual_col: str = "sales",
    forecast_col: str = "forecast_ensemble",
    lower_col: str = "forecast_lower",
    upper_col: str = "forecast_upper",
) -> DataFrame:
    """Daily sums of actual and forecast, and of the bounds where the table has them."""
    columns = [actual_col, forecast_col]
    if lower_col in df.columns and upper_col in df.columns:
        columns += [lower_col, upper_col]
    return df.groupBy("date").agg(*[F.sum(c).alias(c) for c in columns])


def store_heatmap(
    df: DataFrame,
    store_col: str = "store_nbr",
    date_col: str = "date",
    value_col: str = "sales",
    top: int | None = None,
) -> DataFrame:
    """Value per date of all stores, or of the `top` largest, as long rows, 0 where a store has no row.
    The dates of the grid come as one array, bounded by the calendar."""
    cells = df.groupBy(store_col, date_col).agg(F.sum(value_col).alias("_cell"))
    largest = df.groupBy(store_col).agg(F.sum(value_col).alias("_total"))
    if top is not None:
        largest = largest.orderBy(F.desc("_total"), store_col).limit(top)
    dates = df.agg(F.collect_set(date_col)).scalar()
    grid = largest.select(store_col, F.explode(dates).alias(date_col))
    return grid.join(cells, [store_col, date_col], "left").select(
        store_col, date_col, F.coalesce("_cell", F.lit(0.0)).alias(value_col)
    )


def latest_rows(df: DataFrame, n: int | None) -> DataFrame:
    """Rows from the latest date on, the first `n` of them or all (None)."""
    rest = [c for c in ROW_ORDER if c != "date" and c in df.columns]
    ordered = df.orderBy(F.desc("date"), *rest)
    return ordered if n is None else ordered.limit(n)


def positive_costs(inventory: DataFrame) -> DataFrame:
    value = "holding_cost" if "holding_cost" in inventory.columns else "safety_stock"
    return inventory.where(F.col(value) > 0)


def savings_waterfall(saved: DataFrame) -> DataFrame:
    """The four savings figures as rows with their tag and short text."""
    rows = [
        F.struct(
            F.lit(label).alias("category"),
            F.lit(measure).alias("measure"),
            F.col(c).alias("value"),
            money(F.col(c), 1).alias("label"),
        )
        for label, c, measure in WATERFALL
    ]
    return saved.select(F.inline(F.array(*rows)))


def ranked_by(table: DataFrame, metric: str, label: str = "method") -> DataFrame:
    return table.orderBy(metric, label)


def json_payload(**parts: DataFrame | Column | str) -> dict[str, Column]:
    """Columns for a JSON context: a one-row table becomes an object, text stays text."""
    out = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            out[name] = part.select(F.struct(*part.columns)).scalar()
        else:
            out[name] = F.lit(part) if isinstance(part, str) else part
    return out


def forecast_context(df: DataFrame, comparison: DataFrame, label: str = "method") -> DataFrame:
    """Forecast facts and the method comparison as one JSON text."""
    facts = df.agg(
        F.sum("sales").alias("total_sales"),
        F.countDistinct("store_nbr").alias("stores"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("period"),
        F.count(F.lit(1)).alias("records"),
    )
    measures = [c for c in comparison.columns if c != label]
    methods = comparison.agg(
        F.map_from_entries(F.collect_list(F.struct(label, F.struct(*measures))))
    ).scalar()
    return facts.select(
        F.to_json(F.struct(F.struct("*").alias("forecast_summary"), methods.alias("model_comparison"))).alias(
            "payload"
        )
    )


def inventory_context(saved: DataFrame, summary: DataFrame) -> DataFrame:
    parts = json_payload(savings=saved)
    return summary.select(
        F.to_json(
            F.struct(
                parts["savings"].alias("savings"),
                "risk_summary",
                "inventory_health",
                "recommendations",
            )
        ).alias("payload")
    )


def question_context(question: str, saved: DataFrame, summary: DataFrame, df: DataFrame) -> DataFrame:
    stores = df.agg(F.countDistinct("store_nbr")).scalar()
    parts = json_payload(savings=saved)
    context = F.struct(
        parts["savings"].alias("savings"), "risk_summary", stores.alias("total_stores")
    )
    return summary.select(F.to_json(F.struct(F.lit(question).alias("question"), context.alias("data"))).alias("payload"))


def weekly_context(week: str | dt.date, forecast: DataFrame, inventory: DataFrame, saved: DataFrame) -> DataFrame:
    """One-row forecast, inventory and finance tables as the JSON of a weekly report."""
    parts = json_payload(inventory=inventory, financial=saved)
    return forecast.select(
        F.to_json(
            F.struct(
                F.lit(str(week)).alias("week"),
                F.struct("*").alias("forecast"),
                *[c.alias(k) for k, c in parts.items()],
            )
        ).alias("payload")
    )
