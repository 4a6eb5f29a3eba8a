"""Sources: delimited text, Parquet, DataFrames, and a generator of attribution logs."""
