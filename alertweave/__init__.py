"""Security-alert analytics on Spark DataFrames and streams."""
