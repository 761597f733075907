"""Time-series signal research on Spark DataFrames."""
