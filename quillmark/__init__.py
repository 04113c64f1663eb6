"""A Spark-native engine for document review analytics."""
