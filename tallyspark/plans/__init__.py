"""Query builder and results."""
