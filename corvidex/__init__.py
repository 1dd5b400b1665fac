"""A Spark-native document index and retrieval engine."""
