"""Tidemark: a PySpark-native engine for relational queries over versioned tables."""
