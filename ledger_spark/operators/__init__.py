"""Operators over transaction tables; each one maps DataFrames to a DataFrame."""
