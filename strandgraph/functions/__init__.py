"""Column functions on paths, names, patterns and routes."""
