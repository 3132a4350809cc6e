"""Profiles, decision rules, forecasting plans and their execution."""
