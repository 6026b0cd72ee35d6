"""millrace: building and judging datasets of structured model output on Spark DataFrames."""
