"""Operators: functions of DataFrames, keyed by document."""
