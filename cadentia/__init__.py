"""Event-sequence analytics on Spark DataFrames."""
