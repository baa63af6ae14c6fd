"""Lectern: reading-context analytics on Spark DataFrames."""
