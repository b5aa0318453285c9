"""Change-tracking and corpus preparation on Spark DataFrames."""
