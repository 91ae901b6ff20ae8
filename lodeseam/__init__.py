"""Binary-content analytics on Spark DataFrames."""
