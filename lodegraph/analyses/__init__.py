"""Bounded, explainable questions over the code graph."""
