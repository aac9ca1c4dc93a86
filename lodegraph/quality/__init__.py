"""Quality against recorded truth, and order statistics."""
