"""Siltstone: retrieval, indexing and data-processing operators on PySpark DataFrames."""
