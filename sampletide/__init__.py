"""Spark-native observation of the data that flows through applications."""
