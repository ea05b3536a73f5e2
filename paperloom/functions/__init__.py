"""Column functions: text, identity, numbers."""
