"""Document-intelligence analytics on Spark DataFrames."""
