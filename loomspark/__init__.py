"""Spark-native analytics for retrieval corpora and benchmark evaluation."""
