"""Column helpers and skew-safe building blocks."""
