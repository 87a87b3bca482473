"""Column expressions and aggregate functions."""
