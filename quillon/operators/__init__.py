"""Operators: DataFrames of rows or series in, DataFrames of statistics, components or forecasts out."""
