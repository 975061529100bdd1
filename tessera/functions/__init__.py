"""Column functions and lookup values."""
