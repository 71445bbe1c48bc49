"""Operators: every one takes DataFrames and returns a DataFrame, for all plans and periods at once."""
