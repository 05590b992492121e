"""Package of functions."""
