"""Operators: functions from DataFrames to DataFrames. Order is carried by the column seq."""
