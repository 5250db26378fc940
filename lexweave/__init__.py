"""lexweave: document-corpus analytics on Spark DataFrames."""
