"""Operators: functions from DataFrames to DataFrames, lazy and without collects unless their docstring says so."""
