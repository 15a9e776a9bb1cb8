"""Fiscal-document and training-data analytics expressed as Spark DataFrames."""
