"""Operators that a large training-data pipeline needs; nothing else in the library imports this."""
