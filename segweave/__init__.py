"""segweave: ordered text segments and translation memories as Spark DataFrames."""
