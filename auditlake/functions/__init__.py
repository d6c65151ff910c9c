"""Column functions and skew-safe building blocks."""
