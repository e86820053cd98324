"""Millrace: a PySpark-native analytics engine with typed, pipeline-style tables."""

__version__ = "0.1.0"
