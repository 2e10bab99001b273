"""Commerce and logistics reporting jobs on Spark DataFrames."""
