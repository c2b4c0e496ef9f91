"""Spark-native hybrid retrieval and artifact analytics."""
