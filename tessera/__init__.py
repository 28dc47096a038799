"""Spark-native statistical learning and analytical data processing."""
