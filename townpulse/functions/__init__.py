"""Column expressions: dates, numbers, text, lookups, vectors."""
