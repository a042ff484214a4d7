"""Column functions on names, cells and sequences."""
