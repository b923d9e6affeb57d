"""Change validation for replicated tables, on Spark DataFrames."""
