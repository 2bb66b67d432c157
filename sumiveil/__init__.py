"""sumiveil: text-privacy analytics on Spark DataFrames."""
