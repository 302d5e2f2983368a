"""Column expressions: hashing, sketch formulas, numbers."""
