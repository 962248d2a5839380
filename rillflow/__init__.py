"""Ordered dataflow analytics on Spark DataFrames."""
