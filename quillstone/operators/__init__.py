"""Algebra operators lowered to DataFrames."""
