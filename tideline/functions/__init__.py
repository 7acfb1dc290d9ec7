"""Column functions and small helpers that operators share."""
