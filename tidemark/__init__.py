"""Tidemark: a PySpark-native engine for incremental document collections."""
