"""Relational and grouped operators on DataFrames."""
