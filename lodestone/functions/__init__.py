"""Column functions: text primitives that the operators share."""
