"""Relational operators: filters, joins, aggregates, windows, ordering, set operations."""
