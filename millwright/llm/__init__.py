"""Operators of a training-data pipeline over text documents.

Each operator is a function of DataFrames in its own module. `registry` holds the registered queries.
"""
