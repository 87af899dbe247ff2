"""Column expressions and scalar distribution functions."""
