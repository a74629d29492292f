"""Operators on offer and product DataFrames."""
