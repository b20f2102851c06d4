"""Operators: functions from DataFrames to DataFrames. Nulls, ties and empty tables are treated as their docstrings say."""
