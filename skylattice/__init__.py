"""Spark-native analytics for passive time-difference-of-arrival positioning."""
