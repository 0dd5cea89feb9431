"""Column and aggregate helpers shared by the operators."""
