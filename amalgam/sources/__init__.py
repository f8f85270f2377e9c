"""Readers of bibliographic files."""
