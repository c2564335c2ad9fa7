"""Spark-native analytics over compliance evidence."""
