"""Fleet-scale diagnostics for failed SQL-transformation runs, on Spark DataFrames."""
