"""Evidence-aware analytics on Spark DataFrames."""
