"""Structured Streaming forms of the cross-run operators."""
