"""Streams: continuous counts and a continuous index of changes."""
