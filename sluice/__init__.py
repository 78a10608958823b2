"""Batch and stream analytics on Spark DataFrames."""
