"""Operators for training data on text; nothing else in the library imports this subpackage."""
