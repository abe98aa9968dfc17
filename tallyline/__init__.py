"""Usage history of database collections, computed with Spark DataFrames."""
