"""Training-data operators for large document corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; :mod:`tidemark.llm.queries` holds the registered queries.
"""
