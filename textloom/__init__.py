"""A PySpark-native engine for retrieval over semi-structured institutional text."""
