"""guardwalk: a PySpark-native engine for decision programs and corpus work."""
