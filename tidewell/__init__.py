"""Price-cycle analytics on Spark DataFrames."""
