"""Column expressions and the business calendar."""
