"""Structured Streaming counterparts of order-dependent operators."""
