"""Column functions: text, similarity and citation metadata."""
