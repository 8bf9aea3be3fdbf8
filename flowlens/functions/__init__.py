"""Column-expression builders (scalar functions) and fixed value tables."""
