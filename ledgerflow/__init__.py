"""Transaction-graph risk analytics on Spark DataFrames."""
