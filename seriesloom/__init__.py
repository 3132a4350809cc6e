"""Seriesloom: time-series forecasting analytics as Spark DataFrame plans."""
