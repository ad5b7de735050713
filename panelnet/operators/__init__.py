"""Operators: functions from DataFrames to DataFrames with keys and columns as arguments."""
