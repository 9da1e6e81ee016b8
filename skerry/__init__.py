"""Event detection analytics and corpus preparation on Spark DataFrames."""
