"""Security-alert analytics on Spark DataFrames."""
