"""Spark-native shredding and profiling of nested and delimited data."""

__version__ = "0.1.0"
