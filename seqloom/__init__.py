"""Biological-sequence analytics on Spark DataFrames."""
