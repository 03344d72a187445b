"""Readings that keep arriving."""
