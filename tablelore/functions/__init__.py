"""Column expressions and schema tests shared by the operators."""
