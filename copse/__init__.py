"""Histogram forests, and the table work around them, as Spark DataFrames."""
