"""A retrieval and context-packing engine whose operators are Spark DataFrames."""
