"""Operators: functions from DataFrames and parameters to a DataFrame, without hidden actions."""
