"""Column functions that keep to the null rules of the library."""
