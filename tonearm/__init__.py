"""Tonearm: Spark-native analytics for contributor attribution and corpus preparation."""

__version__ = "0.1.0"
