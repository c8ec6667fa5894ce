"""Operators of the collocation engine, each a function from DataFrames to a DataFrame."""
