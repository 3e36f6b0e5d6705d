"""Spark-native analysis of back-office case tables."""

__version__ = "0.1.0"
