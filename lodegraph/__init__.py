"""Spark-native analytics for code dependency graphs and their training-data pipelines."""

__version__ = "0.1.0"
