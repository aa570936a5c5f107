"""laudario: laboratory-report analytics on Spark DataFrames."""
