"""Spark-native catalogue analytics."""
