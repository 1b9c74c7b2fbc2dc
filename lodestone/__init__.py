"""Spark-native analytics over catalogue artifacts."""
