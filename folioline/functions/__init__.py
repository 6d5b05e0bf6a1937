"""Column functions: text, rounding, names, display labels."""
