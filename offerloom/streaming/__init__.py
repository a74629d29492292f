"""Structured Streaming forms of the maintenance operators."""
