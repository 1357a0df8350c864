"""Polymetric: multi-metric similarity and analytics on PySpark."""

__version__ = "0.1.0"
