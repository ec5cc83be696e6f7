"""Structured Streaming forms of the blocking operators."""
