"""Declarative strategy specifications and plan rewrites."""
