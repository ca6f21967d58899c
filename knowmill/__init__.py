"""Spark-native operators for document knowledge pipelines."""
