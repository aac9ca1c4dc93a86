"""The code graph as DataFrames: canonical tables, traversals, whole-graph algorithms."""
