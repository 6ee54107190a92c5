"""Spark-native scholarly text retrieval and corpus processing."""

__version__ = "0.1.0"
