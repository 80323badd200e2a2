"""Process-mining and corpus analytics on Spark DataFrames."""
