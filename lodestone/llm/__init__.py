"""Operators for building training data from source code and text. Nothing else in the library imports this package."""
