"""Spark-native analytics for hierarchical administrative reference data."""
