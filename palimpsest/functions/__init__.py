"""Column expressions for text cleaning, tokens and per-row measures."""
