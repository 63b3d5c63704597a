"""Two-arm trial monitoring on Spark: every function takes and returns DataFrames."""
