"""Relational operators: filters, joins, aggregates, windows, sets, search and merges."""
