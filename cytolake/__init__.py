"""Annotated-matrix analytics on Spark DataFrames."""
