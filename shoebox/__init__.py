"""shoebox: hybrid retrieval and organisation over media-style collections, as PySpark DataFrames."""
