"""The batch operators on streams of files."""
