"""Analytics for mobility marketplaces on Spark DataFrames."""
