"""Operators for training-data pipelines on text and vectors; nothing else in the library imports this."""
