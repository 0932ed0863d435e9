"""Queries over the shared tables."""
