"""Relational operators built on DataFrames."""
