"""Interval-relational analytics on Spark DataFrames."""
