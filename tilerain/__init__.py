"""Earth-observation tile analytics on Spark DataFrames."""
