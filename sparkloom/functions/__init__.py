"""Column expressions shared by the operators."""
