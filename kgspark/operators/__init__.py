"""Operators over record tables, each a function from DataFrames to a DataFrame."""
