"""Operators on contact tables, contact maps and tracks: functions from DataFrames to DataFrames."""
