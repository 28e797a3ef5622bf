"""Graph, history and vocabulary analytics on Spark DataFrames."""
