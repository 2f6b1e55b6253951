"""Process-telemetry anomaly analytics on Spark DataFrames."""
