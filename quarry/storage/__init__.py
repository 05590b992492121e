"""Mutable tables as versions of Parquet files, key-value tables and text copies."""
