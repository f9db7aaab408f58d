"""Operators for training-data work on text and records; nothing else in the library imports this."""
