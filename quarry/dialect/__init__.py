"""The SQL front end."""

from .rewrite import DialectError, to_spark

__all__ = ["DialectError", "to_spark"]
