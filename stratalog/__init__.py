"""Stratalog: episode analytics on Spark DataFrames."""
