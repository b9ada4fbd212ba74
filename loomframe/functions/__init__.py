"""Column functions: cleaning, normalising, scoring."""
