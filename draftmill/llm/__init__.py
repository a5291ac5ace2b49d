"""Operators for building training corpora. Nothing else in the library imports this package."""
