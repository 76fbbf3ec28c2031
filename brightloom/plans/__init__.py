"""Schemas, row counts and the table registry."""
