"""Evidence-grounded matching and ranking of documents, and corpus operators, on Spark DataFrames."""
