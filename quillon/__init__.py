"""Numerical, statistical and time-series analytics on Spark DataFrames."""
