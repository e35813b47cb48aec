"""Interval operators: each takes DataFrames with `ts` and `te` and returns a lazy DataFrame."""
