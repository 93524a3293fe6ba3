"""netloom: network-flow analytics on Spark DataFrames and Structured Streaming."""
