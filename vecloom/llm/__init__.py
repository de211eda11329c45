"""Operators of a training-data pipeline over documents and embeddings.

Nothing else in the library imports this subpackage. Each operator takes
DataFrames and returns one; ``queries`` registers them over the tables.
"""
