"""Document intelligence and corpus preparation on Spark DataFrames."""
