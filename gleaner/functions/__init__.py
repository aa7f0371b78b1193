"""Column functions: text, ranking, vectors."""
