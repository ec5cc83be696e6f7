"""Column expressions: text, address and similarity functions."""
