"""Operators: functions from DataFrames to DataFrames, composed of built-in expressions."""
