"""weft: analytics on Spark DataFrames."""
