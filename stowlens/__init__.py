"""Storage-telemetry analytics on Spark DataFrames."""
