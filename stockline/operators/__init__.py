"""Operators: filters, joins, reports, table changes and data-quality rules."""
