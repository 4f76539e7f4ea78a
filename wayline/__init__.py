"""Spark-first analytics over road-condition surveys."""

__version__ = "0.1.0"
