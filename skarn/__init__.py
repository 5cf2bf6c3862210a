"""Document retrieval, retrieval evaluation and corpus preparation on Spark DataFrames."""
