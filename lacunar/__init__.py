"""Missing-value analytics on Spark DataFrames, and operators for text corpora."""
