"""Readers: every source is a function that returns a DataFrame."""
