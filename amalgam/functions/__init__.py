"""Column functions: text, identifiers, fields, keys, comparison and scoring."""
