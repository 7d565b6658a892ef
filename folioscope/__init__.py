"""Compare revisions of text documents at scale, on Spark DataFrames."""
