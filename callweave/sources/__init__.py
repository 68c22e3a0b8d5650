"""Readers: call files (text and binary), repeat catalogs, target regions, path lists, headers."""
