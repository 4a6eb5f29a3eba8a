"""Operators over DataFrames: predicates, aggregates, first-appearance dictionaries, table summaries."""
