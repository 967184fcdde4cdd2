"""Relational, graph, interval and similarity operators: functions from DataFrames to DataFrames."""
