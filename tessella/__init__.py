"""Tessella: a PySpark-native engine for document preparation and retrieval analytics."""

__version__ = "0.1.0"
