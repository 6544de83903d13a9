"""Column types, aggregates and scalar functions."""
