"""Operators for citation graphs, text analytics and their reports, as functions from DataFrames to DataFrames."""
