"""Column and DataFrame helpers shared by all operators."""
