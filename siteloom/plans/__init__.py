"""Projection plans: a format string to columns of text."""
