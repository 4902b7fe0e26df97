"""Spark-native phylodynamics and record-processing engine."""

__version__ = "0.1.0"
