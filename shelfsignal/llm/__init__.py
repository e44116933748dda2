"""Training-data operators (deduplication, tokenizing, extraction, filtering) on Spark DataFrames."""
