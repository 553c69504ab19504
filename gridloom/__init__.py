"""gridloom: parallel array analytics on Spark DataFrames."""
