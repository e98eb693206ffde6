"""Where tables come from and where rows go."""
