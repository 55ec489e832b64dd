"""Operators: functions from DataFrame and column names to DataFrame."""
