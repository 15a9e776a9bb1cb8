"""Training-data operators: counting, deduplication, filtering and encoding of text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names,
ignores columns it was not told about, and states its treatment of nulls, empty texts and ties.
"""
