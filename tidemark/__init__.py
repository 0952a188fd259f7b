"""Tidemark: news and market analytics on PySpark DataFrames."""
