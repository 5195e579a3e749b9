"""Retail demand forecasting and inventory analytics as plain Spark jobs."""
