"""Versions of a stored graph."""
