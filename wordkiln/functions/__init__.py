"""Column expressions over texts, tokens and vectors."""
