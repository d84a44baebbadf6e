"""Operators for preparing large training-text corpora. Nothing else in the library imports this."""
