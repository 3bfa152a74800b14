"""Spark-native analytics over point-in-time time-series panels."""
