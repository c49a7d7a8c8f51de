"""Operators: functions from DataFrames to DataFrames, lazily planned unless their docstring says otherwise."""
