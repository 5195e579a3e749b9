"""Reorder point, order quantity and yearly cost of each segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.scalar import ceil_units, ratio

DAYS_PER_YEAR = 365


@dataclass(frozen=True)
class ReorderSettings:
    lead_time_days: int = 7
    review_period_days: int = 7
    ordering_cost: float = 50.0
    holding_cost_pct: float = 0.25
    avg_unit_cost: float = 10.0

    @property
    def holding_cost(self) -> float:
        """Holding one unit for a year."""
        return self.avg_unit_cost * self.holding_cost_pct


def reorder_point(daily_demand: Column, stock: Column, lead_time_days: int) -> Column:
    return ceil_units(daily_demand * lead_time_days + stock)


def economic_order_quantity(annual_demand: Column, ordering_cost: float, holding_cost: float) -> Column:
    if holding_cost <= 0:
        return F.lit(0.0)
    root = F.sqrt(F.lit(2.0) * annual_demand * F.lit(float(ordering_cost)) / F.lit(float(holding_cost)))
    return F.when(annual_demand > 0, F.greatest(F.ceil(root).cast("double"), F.lit(1.0))).otherwise(0.0)


def order_up_to_level(
    daily_demand: Column, stock: Column, lead_time_days: int, review_period_days: int
) -> Column:
    return ceil_units(daily_demand * (review_period_days + lead_time_days) + stock)


def total_costs(
    annual_demand: Column, order_quantity: Column, stock: Column, settings: ReorderSettings
) -> dict[str, Column]:
    """Yearly cost parts of ordering `order_quantity` at a time. Without an order quantity the
    costs are 0 and the counts and rates are missing."""
    ordered = order_quantity > 0
    orders = F.when(ordered, F.try_divide(annual_demand, order_quantity))
    average = F.when(ordered, order_quantity / 2 + stock)
    holding = settings.holding_cost

    def or_zero(x: Column) -> Column:
        return F.when(ordered, x).otherwise(0.0)

    ordering, carrying = orders * settings.ordering_cost, average * holding
    product = annual_demand * settings.avg_unit_cost
    turnover = F.when(average > 0, ratio(annual_demand, average, 0.0)).otherwise(0.0)
    supply = F.when(
        annual_demand > 0, ratio(average, annual_demand / DAYS_PER_YEAR, 0.0)
    ).otherwise(0.0)
    return {
        "n_orders_per_year": orders,
        "ordering_cost": or_zero(ordering),
        "holding_cost": or_zero(carrying),
        "safety_stock_cost": or_zero(stock * holding),
        "product_cost": or_zero(product),
        "total_cost": or_zero(ordering + carrying + product),
        "avg_inventory_units": average,
        "inventory_turnover": F.when(ordered, turnover),
        "days_of_supply": F.when(ordered, supply),
    }


def reorder_plan(
    stock: DataFrame, forecast_horizon_days: int = 30, settings: ReorderSettings = ReorderSettings()
) -> DataFrame:
    """Inventory recommendations from the safety stock table; no further shuffle."""
    demand, ss = F.col("avg_daily_demand"), F.col("safety_stock")
    annual = demand * DAYS_PER_YEAR
    base = stock.select(
        "segment",
        "avg_daily_demand",
        "safety_stock",
        reorder_point(demand, ss, settings.lead_time_days).alias("reorder_point"),
        economic_order_quantity(annual, settings.ordering_cost, settings.holding_cost).alias("eoq"),
        order_up_to_level(
            demand, ss, settings.lead_time_days, settings.review_period_days
        ).alias("order_up_to_level"),
        (demand * forecast_horizon_days).alias("demand_next_30d"),
        annual.alias("annual_demand"),
        "service_level",
    )
    costs = total_costs(F.col("annual_demand"), F.col("eoq"), ss, settings)
    return base.select("*", *[c.alias(name) for name, c in costs.items()])
