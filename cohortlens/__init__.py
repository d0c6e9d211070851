"""Cohort text analytics on Spark: every operator takes DataFrames and returns a DataFrame."""

__version__ = "0.1.0"
