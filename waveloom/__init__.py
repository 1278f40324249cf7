"""waveloom: signal-segment analytics on Spark DataFrames."""
