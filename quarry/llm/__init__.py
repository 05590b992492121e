"""Operators that prepare training text: deduplication, filtering, tokenising, packing and archive formats.

Nothing else in the library imports this subpackage.  ``registry`` holds the queries and their SQL.
"""
