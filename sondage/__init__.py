"""sondage: survey analytics on Spark DataFrames."""
