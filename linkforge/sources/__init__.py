"""Readers for entity tables, link lists and test fixtures."""
