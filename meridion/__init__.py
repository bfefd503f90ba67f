"""Equal-area map geometry and corpus preparation on Spark DataFrames."""
