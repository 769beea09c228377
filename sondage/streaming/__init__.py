"""Structured Streaming twins of the record operators."""
