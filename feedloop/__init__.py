"""Spark-native analytics for interactive, feedback-driven recommendation."""

__version__ = "0.1.0"
