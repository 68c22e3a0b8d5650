"""Writers: call files, diagnostics tables, parquet."""
