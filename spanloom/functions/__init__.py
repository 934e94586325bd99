"""Column functions: parsing, geometry and sequences."""
