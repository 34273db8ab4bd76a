"""Spark-native text measurement and evidence graphs."""

__version__ = "0.1.0"
