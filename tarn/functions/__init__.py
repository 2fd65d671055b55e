"""Column expressions: text, JSON, vectors, scores, times."""
