"""Content ranking and audience analytics on Spark DataFrames."""
