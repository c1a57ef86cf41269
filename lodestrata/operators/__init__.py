"""Operators over findings, runs, logs and chunks: DataFrames in, a DataFrame out."""
