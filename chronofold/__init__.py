"""chronofold: point-in-time feature computation over event data, built on Spark DataFrames."""
