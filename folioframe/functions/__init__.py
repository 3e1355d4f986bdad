"""Column functions: every rule that works on one row."""
