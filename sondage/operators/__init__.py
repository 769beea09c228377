"""Operators: functions from DataFrames to DataFrames, one module for each kind of survey."""
