"""Spark-native analytics for large numeric tables: every operator takes and returns DataFrames."""

__version__ = "0.1.0"
