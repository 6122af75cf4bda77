"""Interval, coverage and enrichment analytics on Spark DataFrames."""
