"""Spark-native evidence and rank-assignment engine."""

__version__ = "0.1.0"
