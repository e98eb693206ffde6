"""The recipes, one module per question asked of a table."""
