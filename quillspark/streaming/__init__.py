"""Structured Streaming versions of operators that work on rows as they come."""
