"""Column expressions: numbers and text, portable hashing, risk rules."""
