"""Multi-agent trajectory analytics on Spark DataFrames."""
