"""Statistical analytics on Spark DataFrames."""
