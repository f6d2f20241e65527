"""Column expressions and small driver-side functions."""
