"""Scalar functions and named compatibility semantics."""
