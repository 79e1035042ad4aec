"""Reports: each function takes table DataFrames and returns a lazy DataFrame."""
