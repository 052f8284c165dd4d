"""Spark-native analytics for text-recognition pipelines, and training-data operators."""
