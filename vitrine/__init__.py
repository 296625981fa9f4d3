"""Vitrine: a PySpark-native engine for product-search analytics and learning to rank."""

__version__ = "0.1.0"
