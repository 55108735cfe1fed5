"""Timeline analytics on DataFrames."""
