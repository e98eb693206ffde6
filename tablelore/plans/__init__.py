"""Combinations of operators that answer a whole question."""
