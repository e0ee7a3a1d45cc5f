"""Column functions: scalars, vectors, text."""
