"""Column-level expressions (Column in, Column out)."""
