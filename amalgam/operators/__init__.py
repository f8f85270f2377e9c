"""Operators that turn DataFrames into DataFrames."""
