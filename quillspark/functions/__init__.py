"""Scalar functions for SQL text."""
