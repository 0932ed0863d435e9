"""Document and catalog analytics as DataFrame functions."""
