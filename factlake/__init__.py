"""factlake: a versioned fact store with hybrid search, as plain Spark DataFrames."""
