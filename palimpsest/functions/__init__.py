"""Scalar and predicate functions as Column expressions."""
