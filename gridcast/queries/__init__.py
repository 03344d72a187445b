"""Registered queries, each with SQL that gives the same rows."""

from gridcast.queries import curation, filling, forecasts, marking, quality, reading, slicing  # noqa: F401
from gridcast.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
