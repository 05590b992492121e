"""Registered queries: ``QUERIES`` by name, ``SQL`` with the same rows in DuckDB's dialect."""

from . import mutable, relational, scalar, search, streams  # noqa: F401  each registers its queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
