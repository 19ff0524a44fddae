"""Column functions: text, similarity and number formats."""
