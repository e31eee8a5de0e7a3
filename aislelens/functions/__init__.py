"""Column expressions, fixed labels and the skew-safe building blocks."""
