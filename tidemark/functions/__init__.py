"""Column functions: JSON navigation, request building, type conformance."""
