"""Media-index analytics and corpus operators on Spark DataFrames."""
