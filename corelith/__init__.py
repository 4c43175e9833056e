"""corelith: dense-subgraph analytics over Spark DataFrames."""
