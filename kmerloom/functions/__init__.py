"""Column functions on DNA strings."""
