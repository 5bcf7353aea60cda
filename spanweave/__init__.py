"""Spark-native analytics over structured, citation-rich documents."""

__version__ = "0.1.0"
