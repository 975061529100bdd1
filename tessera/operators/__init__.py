"""Operators: DataFrames in, DataFrames out, many projects in one plan."""
