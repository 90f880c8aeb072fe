"""Spark-native analytics for archives of letters: retrieval, nested records, reference checks."""
