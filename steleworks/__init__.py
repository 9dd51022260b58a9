"""A Spark-native engine for document and inscription analytics."""
