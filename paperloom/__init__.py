"""Spark-native analytics for tender and document packages."""
