"""Customer and order analytics on Spark DataFrames."""
