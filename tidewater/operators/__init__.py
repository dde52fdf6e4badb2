"""Relational and training-data operators, each a function from DataFrames to a DataFrame."""
