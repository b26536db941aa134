"""Column-level helpers: names, grouping keys and text expressions."""
