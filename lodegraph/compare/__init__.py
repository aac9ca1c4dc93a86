"""Comparison of two revisions at the level of symbols."""
