"""Strictly typed SQL analytics on Spark DataFrames."""
