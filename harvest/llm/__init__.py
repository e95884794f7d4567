"""Operators that prepare training data: each takes and returns DataFrames."""
