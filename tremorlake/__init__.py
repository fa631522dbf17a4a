"""Spark-native change-impact analytics."""
