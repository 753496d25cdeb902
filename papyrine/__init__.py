"""Document-centred research analytics on PySpark DataFrames."""
