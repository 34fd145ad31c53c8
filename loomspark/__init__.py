"""loomspark: document curation on PySpark DataFrames."""
