"""Bulk analytics over a collection of linked Markdown notes, on Spark DataFrames."""
