"""Queries over the tables, one for each operator."""
