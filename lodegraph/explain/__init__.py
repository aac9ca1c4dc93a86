"""Explanations from numbered facts, and the check of what a model says about them."""
