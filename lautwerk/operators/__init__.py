"""Operators on DataFrames of forms."""
