"""Column functions: everything here takes columns and returns a column."""
