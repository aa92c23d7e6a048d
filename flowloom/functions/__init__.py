"""Column expressions and the two table primitives (ordered scan, exact quantiles)."""
