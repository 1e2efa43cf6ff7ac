"""linkguard: URL and IP threat analytics on Spark DataFrames."""
