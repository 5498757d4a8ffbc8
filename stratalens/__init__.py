"""Retrieval analytics over versioned, tagged and embedded documents, on Spark DataFrames."""
