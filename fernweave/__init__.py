"""fernweave: hybrid text retrieval and its evaluation on Spark DataFrames."""
