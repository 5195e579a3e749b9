"""Schemas of the input and output tables."""

from __future__ import annotations

SALES = "date date, store_nbr int, family string, sales double, onpromotion int"
STORES = "store_nbr int, city string, state string, store_type string, cluster int"
OIL = "date date, dcoilwtico double"
HOLIDAYS = "date date, type string, locale string, transferred boolean"
TRANSACTIONS = "date date, store_nbr int, transactions int"

RAW = {
    "train": SALES,
    "stores": STORES,
    "oil": OIL,
    "holidays": HOLIDAYS,
    "transactions": TRANSACTIONS,
}
RAW_FILES = {
    "train": "train.csv",
    "stores": "stores.csv",
    "oil": "oil.csv",
    "holidays": "holidays_events.csv",
    "transactions": "transactions.csv",
}

FORECASTS = (
    "date date, store_nbr int, family string, sales double, forecast_xgboost double, "
    "forecast_rf double, forecast_prophet double, forecast_ensemble double, "
    "forecast_lower double, forecast_upper double"
)
INVENTORY = (
    "segment int, avg_daily_demand double, safety_stock double, reorder_point double, eoq double, "
    "order_up_to_level double, demand_next_30d double, annual_demand double, service_level double, "
    "n_orders_per_year double, ordering_cost double, holding_cost double, safety_stock_cost double, "
    "product_cost double, total_cost double, avg_inventory_units double, inventory_turnover double, "
    "days_of_supply double"
)
RISK = (
    "segment int, avg_daily_demand double, safety_stock double, variability_risk double, "
    "adequacy_risk double, trend_risk double, volume_risk double, composite_risk_score double, "
    "risk_category string, recommendation string, daily_revenue_at_risk double, "
    "weekly_revenue_at_risk double, demand_trend_pct double, trend_known boolean"
)
_METHOD = (
    "struct<mape double, forecast_accuracy double, total_over_forecast_units double, "
    "total_under_forecast_units double, excess_inventory_cost double, stockout_cost double, "
    "total_cost_of_errors double, rmse double>"
).replace(" double", ":double").replace(", ", ",")
FINANCIAL = (
    f"comparison map<string,{_METHOD}>, "
    "savings struct<holding_cost_savings:double,stockout_cost_savings:double,"
    "total_direct_savings:double,accuracy_improvement_pct:double,"
    "excess_inventory_reduction_units:double,working_capital_freed:double,"
    "working_capital_cost_saved:double,annualized_savings_estimate:double,"
    "annualized_capital_freed:double,savings_pct:double>, "
    "executive_summary struct<"
    "headline_metrics:struct<annual_savings_estimate:double,forecast_accuracy_improvement:double,"
    "working_capital_freed:double,cost_reduction_pct:double>,"
    "inventory_health:struct<avg_inventory_turnover:double,avg_days_of_supply:double,"
    "total_safety_stock_cost:double>,"
    "risk_summary:struct<high_risk_segments:bigint,total_segments:bigint,"
    "total_weekly_exposure:double,top_risk_segments:array<struct<segment:int,"
    "composite_risk_score:double,risk_category:string,weekly_revenue_at_risk:double>>>,"
    "recommendations:array<struct<priority:string,action:string,impact:string>>>"
)
