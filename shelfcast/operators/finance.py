"""Cost of forecast errors, savings against a baseline, stock-out risk and their summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.scalar import avg_where, clip, ratio
from shelfcast.operators.joins import null_safe_join
from shelfcast.operators.ordinal import lag_by_position, with_position

# Method names, risk weights, thresholds and texts.
AI = "AI Ensemble"
NAIVE = "Naive (Last Period)"
SEASONAL = "Seasonal Naive"
RISK_WEIGHTS = {"variability_risk": 0.35, "adequacy_risk": 0.30, "trend_risk": 0.20, "volume_risk": 0.15}
RISK_LEVELS = [
    ("HIGH", 70.0, "Increase safety stock by 20-30%"),
    ("MEDIUM", 40.0, "Monitor closely, consider 10% buffer"),
    ("LOW", None, "Current levels adequate"),
]
MIN_TREND_ROWS = 7
HIGH_VOLUME = 500.0
MEASURES = [
    "mape",
    "forecast_accuracy",
    "total_over_forecast_units",
    "total_under_forecast_units",
    "excess_inventory_cost",
    "stockout_cost",
    "total_cost_of_errors",
    "rmse",
]


@dataclass(frozen=True)
class FinanceSettings:
    avg_unit_price: float = 15.0
    avg_unit_cost: float = 10.0
    holding_cost_pct: float = 0.25
    stockout_cost_multiplier: float = 1.5
    working_capital_cost: float = 0.08
    test_days: int = 16

    @property
    def margin(self) -> float:
        return self.avg_unit_price - self.avg_unit_cost


def seasonal_naive(
    df: DataFrame,
    segment_col: str | Sequence[str] = "store_nbr",
    actual_col: str = "sales",
    order: Sequence[str] = ("date", "family"),
    lag: int = 7,
    out: str = "seasonal_naive",
) -> DataFrame:
    """Actual of `lag` rows earlier in the segment, else the segment's mean. A segment may be one column
    or several; with the series ("store_nbr", "family") and the order ("date",) it lags by days. The
    order must tell all rows of a segment apart, or the result depends on how the table is read."""
    segment = [segment_col] if isinstance(segment_col, str) else list(segment_col)
    means = df.groupBy(*segment).agg(F.avg(actual_col).alias("_segment_mean"))
    placed = with_position(df, segment, order, "_pos")
    lagged = lag_by_position(placed, segment, "_pos", actual_col, lag, "_lagged")
    joined = null_safe_join(lagged, means, segment)
    return joined.withColumn(out, F.coalesce("_lagged", "_segment_mean")).drop(
        "_pos", "_lagged", "_segment_mean"
    )


def compare_methods(
    df: DataFrame,
    methods: Mapping[str, str | Column],
    actual_col: str = "sales",
    periods: int | None = None,
    settings: FinanceSettings = FinanceSettings(),
) -> DataFrame:
    """One row of error and cost measures per forecast method, all from one pass. `periods`
    scales the holding cost; the default is the number of rows that have both an actual and the
    method's forecast."""
    actual = F.col(actual_col)
    aggs = []
    for i, forecast in enumerate(methods.values()):
        f = F.col(forecast) if isinstance(forecast, str) else forecast
        error = actual - f
        aggs += [
            avg_where(F.abs(error) / actual, actual > 0, 1.0).alias(f"_mape{i}"),
            F.coalesce(F.sum(clip(-error, 0.0)), F.lit(0.0)).alias(f"_over{i}"),
            F.coalesce(F.sum(clip(error, 0.0)), F.lit(0.0)).alias(f"_under{i}"),
            F.sqrt(F.avg(error * error)).alias(f"_rmse{i}"),
            F.count(error).alias(f"_n{i}"),
        ]
    rows = []
    for i, name in enumerate(methods):
        n = F.col(f"_n{i}") if periods is None else F.lit(periods)
        over, under, mape = F.col(f"_over{i}"), F.col(f"_under{i}"), F.col(f"_mape{i}")
        holding = over * settings.avg_unit_cost * settings.holding_cost_pct / 365 * n
        stockout = under * settings.margin * settings.stockout_cost_multiplier
        values = [mape, 1 - mape, over, under, holding, stockout, holding + stockout, F.col(f"_rmse{i}")]
        rows.append(
            F.struct(F.lit(name).alias("method"), *[v.alias(m) for v, m in zip(values, MEASURES)])
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def savings(
    comparison: DataFrame,
    ai: str = AI,
    baseline: str = NAIVE,
    settings: FinanceSettings = FinanceSettings(),
) -> DataFrame:
    """One row of differences between the AI forecast and a baseline method."""

    def side(name: str, alias: str) -> Column:
        picked = F.when(F.col("method") == name, F.struct(*MEASURES))
        return F.max(picked).alias(alias)

    both = comparison.agg(side(ai, "a"), side(baseline, "b"))

    def gain(m: str) -> Column:
        return F.col(f"b.{m}") - F.col(f"a.{m}")

    yearly = 365 / settings.test_days
    units = gain("total_over_forecast_units")
    total = gain("total_cost_of_errors")
    capital = units * settings.avg_unit_cost
    base_cost = F.col("b.total_cost_of_errors")
    return both.select(
        gain("excess_inventory_cost").alias("holding_cost_savings"),
        gain("stockout_cost").alias("stockout_cost_savings"),
        total.alias("total_direct_savings"),
        ((F.col("a.forecast_accuracy") - F.col("b.forecast_accuracy")) * 100).alias(
            "accuracy_improvement_pct"
        ),
        units.alias("excess_inventory_reduction_units"),
        capital.alias("working_capital_freed"),
        (capital * settings.working_capital_cost).alias("working_capital_cost_saved"),
        (total * yearly).alias("annualized_savings_estimate"),
        (capital * yearly).alias("annualized_capital_freed"),
        F.when(base_cost > 0, ratio(total, base_cost, 0.0) * 100).otherwise(0.0).alias("savings_pct"),
    )


def half_means(
    df: DataFrame,
    segment_col: str = "store_nbr",
    value_col: str = "forecast_ensemble",
    order: Sequence[str] = ("date", "family"),
) -> DataFrame:
    """Per segment: rows, mean of the first n//2 rows and mean of the rest, in the order given: its
    first column forms blocks, the others order the rows of a block. Only block totals are shuffled; of the rows themselves just the
    one block per segment that holds the midpoint is ranked."""
    block, within = order[0], list(order[1:]) or [order[0]]
    data = df.select(F.col(segment_col).alias("segment"), *dict.fromkeys([block, *within, value_col]))
    blocks = data.groupBy("segment", block).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(value_col).alias("_sum")
    )
    segment = Window.partitionBy("segment")
    before = segment.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns(
        {
            "_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_mid": F.floor(F.sum("_rows").over(segment) / 2),
        }
    )
    start, end, mid = F.col("_start"), F.col("_start") + F.col("_rows"), F.col("_mid")
    straddling = placed.where((start < mid) & (mid < end)).select(
        "segment", block, (mid - start).alias("_first_rows")
    )
    ranked = null_safe_join(data, straddling, ["segment", block], "inner").withColumn(
        "_place", F.row_number().over(Window.partitionBy("segment", block).orderBy(*within))
    )
    split = ranked.groupBy("segment", block).agg(
        F.sum(F.when(F.col("_place") <= F.col("_first_rows"), F.col(value_col))).alias("_split_first"),
        F.sum(F.when(F.col("_place") > F.col("_first_rows"), F.col(value_col))).alias("_split_second"),
    )
    joined = null_safe_join(placed, split, ["segment", block])
    first = F.when(end <= mid, F.col("_sum")).otherwise(F.col("_split_first"))
    second = F.when(start >= mid, F.col("_sum")).otherwise(F.col("_split_second"))
    totals = joined.groupBy("segment").agg(
        F.sum("_rows").alias("n_rows"), F.sum(first).alias("_first"), F.sum(second).alias("_second")
    )
    half = F.floor(F.col("n_rows") / 2)
    return totals.select(
        "segment",
        "n_rows",
        F.try_divide("_first", half).alias("first_half"),
        F.try_divide("_second", F.col("n_rows") - half).alias("second_half"),
    )


def stockout_risk(
    forecasts: DataFrame,
    stock: DataFrame,
    forecast_col: str = "forecast_ensemble",
    segment_col: str = "store_nbr",
    order: tuple[str, ...] = ("date", "family"),
    settings: FinanceSettings = FinanceSettings(),
    min_rows: int = MIN_TREND_ROWS,
) -> DataFrame:
    """Risk score, category and exposure of the segments present in both tables, NULL among them. A segment
    of fewer than `min_rows` forecast rows has no trend: its trend risk is 50, and `trend_known` is false."""
    halves = half_means(forecasts, segment_col, forecast_col, order)
    df = null_safe_join(stock, halves, ["segment"], "inner")
    demand, std = F.col("avg_daily_demand"), F.col("forecast_error_std")
    cv = F.when(demand > 0, ratio(std, demand, 1.0)).otherwise(1.0)
    known = F.col("n_rows") >= min_rows
    trend = (F.col("second_half") - F.col("first_half")) / (F.col("first_half") + 1e-6) * 100
    scored = df.select(
        "segment",
        "avg_daily_demand",
        "safety_stock",
        F.least(F.lit(100.0), cv * 100).alias("variability_risk"),
        F.greatest(F.lit(0.0), 100 - F.col("safety_stock") / (std + 1e-6) * 30).alias("adequacy_risk"),
        F.when(known, clip(trend * 2, 0, 100)).otherwise(50.0).alias("trend_risk"),
        F.least(F.lit(100.0), demand / HIGH_VOLUME * 100).alias("volume_risk"),
        F.when(known, trend).otherwise(0.0).alias("demand_trend_pct"),
        known.alias("trend_known"),
    )
    score = sum((F.col(c) * w for c, w in RISK_WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumn("composite_risk_score", score)
    (high, high_from, high_text), (mid, mid_from, mid_text), (low, _, low_text) = RISK_LEVELS
    s = F.col("composite_risk_score")
    exposure = demand * settings.margin
    return scored.select(
        *[c for c in scored.columns if c not in ("demand_trend_pct", "trend_known")],
        F.when(s >= high_from, high).when(s >= mid_from, mid).otherwise(low).alias("risk_category"),
        F.when(s >= high_from, high_text)
        .when(s >= mid_from, mid_text)
        .otherwise(low_text)
        .alias("recommendation"),
        exposure.alias("daily_revenue_at_risk"),
        (exposure * 7).alias("weekly_revenue_at_risk"),
        "demand_trend_pct",
        "trend_known",
    )


def top_risks(risk: DataFrame, n: int = 5) -> DataFrame:
    return (
        risk.select("segment", "composite_risk_score", "risk_category", "weekly_revenue_at_risk")
        .orderBy(F.desc("composite_risk_score"), "segment")
        .limit(n)
    )


def recommendations(annual: Column, accuracy: Column, high_risk: Column) -> Column:
    """Array of advice (priority, action, impact) whose rule holds."""

    def advice(priority: str, action: Column, impact: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), action.alias("action"), impact.alias("impact")
        )

    rules = [
        F.when(
            annual > 10000,
            advice(
                "HIGH",
                F.lit("Implement AI-driven reorder system across all stores"),
                F.format_string("$%,.0f annual savings", annual),
            ),
        ),
        F.when(
            high_risk > 0,
            advice(
                "HIGH",
                F.format_string("Review safety stock levels for %d high-risk segments", high_risk),
                F.lit("Prevent potential stockouts and revenue loss"),
            ),
        ),
        F.when(
            accuracy > 5,
            advice(
                "MEDIUM",
                F.lit("Transition from manual to AI-based demand planning"),
                F.format_string("%.1f%% accuracy improvement", accuracy),
            ),
        ),
        advice(
            "MEDIUM",
            F.lit("Set up automated weekly model retraining pipeline"),
            F.lit("Maintain forecast accuracy as patterns evolve"),
        ),
    ]
    return F.array_compact(F.array(*rules))


def executive_summary(saved: DataFrame, risk: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: headline metrics, inventory health, risk summary with the top five segments,
    recommendations. The top five come from a limited sort, not from a list of all segments."""
    health = inventory.agg(
        F.struct(
            F.avg("inventory_turnover").alias("avg_inventory_turnover"),
            F.avg("days_of_supply").alias("avg_days_of_supply"),
            F.sum("safety_stock_cost").alias("total_safety_stock_cost"),
        )
    ).scalar()
    counts = risk.agg(
        F.struct(
            F.count_if(F.col("risk_category") == "HIGH").alias("high_risk_segments"),
            F.count(F.lit(1)).alias("total_segments"),
            F.sum("weekly_revenue_at_risk").alias("total_weekly_exposure"),
        )
    ).scalar()
    best_first = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("composite_risk_score")).alias("_rank"),
                "segment",
                "composite_risk_score",
                "risk_category",
                "weekly_revenue_at_risk",
            )
        )
    )
    top = top_risks(risk).agg(F.transform(best_first, lambda x: x.dropFields("_rank"))).scalar()
    row = saved.select("*", counts.alias("_counts"), health.alias("_health"), top.alias("_top"))
    return row.select(
        F.struct(
            F.col("annualized_savings_estimate").alias("annual_savings_estimate"),
            F.col("accuracy_improvement_pct").alias("forecast_accuracy_improvement"),
            F.col("annualized_capital_freed").alias("working_capital_freed"),
            F.col("savings_pct").alias("cost_reduction_pct"),
        ).alias("headline_metrics"),
        F.col("_health").alias("inventory_health"),
        F.struct(
            F.col("_counts.high_risk_segments").alias("high_risk_segments"),
            F.col("_counts.total_segments").alias("total_segments"),
            F.col("_counts.total_weekly_exposure").alias("total_weekly_exposure"),
            F.col("_top").alias("top_risk_segments"),
        ).alias("risk_summary"),
        recommendations(
            F.col("annualized_savings_estimate"),
            F.col("accuracy_improvement_pct"),
            F.col("_counts.high_risk_segments"),
        ).alias("recommendations"),
    )


def result_summary(risk: DataFrame, inventory: DataFrame, stock: DataFrame) -> DataFrame:
    """One row with the totals a run reports."""
    totals = inventory.agg(
        F.avg("inventory_turnover").alias("avg_turnover"),
        F.avg("days_of_supply").alias("avg_days_of_supply"),
        F.sum("ordering_cost").alias("total_ordering_cost"),
        F.sum("holding_cost").alias("total_holding_cost"),
    )
    risks = risk.agg(
        F.struct(
            F.count_if(F.col("risk_category") == "HIGH").alias("high_risk"),
            F.count_if(F.col("risk_category") == "MEDIUM").alias("medium_risk"),
            F.count_if(F.col("risk_category") == "LOW").alias("low_risk"),
            F.sum("weekly_revenue_at_risk").alias("total_weekly_exposure"),
        )
    ).scalar()
    stocks = stock.agg(
        F.struct(
            F.count(F.lit(1)).alias("segments"),
            F.sum("safety_stock").alias("total_safety_stock"),
            F.avg("safety_stock_days").alias("avg_safety_stock_days"),
        )
    ).scalar()
    return totals.select("*", risks.alias("_r"), stocks.alias("_s")).select(
        *totals.columns, "_r.*", "_s.*"
    )
