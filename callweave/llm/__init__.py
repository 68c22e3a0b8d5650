"""Training-data operators: survivors of duplicate groups, similar vectors, near copies, tokens, leaks, personal data."""
