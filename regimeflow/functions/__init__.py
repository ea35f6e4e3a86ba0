"""Column expressions: activations, vectors and dates."""
