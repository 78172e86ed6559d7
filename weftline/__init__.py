"""Analytics over work plans, runs and evidence as Spark DataFrames."""
