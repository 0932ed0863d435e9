"""Column functions and sequential text functions."""
