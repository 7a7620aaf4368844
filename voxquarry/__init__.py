"""Speech-corpus analytics on Spark DataFrames."""
