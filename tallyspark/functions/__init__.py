"""Column expressions: field parsing, group keys and buckets."""
