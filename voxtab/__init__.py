"""Free-text feedback analytics on Spark DataFrames."""
