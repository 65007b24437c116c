"""scriptorium: content analytics on Spark DataFrames."""
