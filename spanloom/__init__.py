"""Spark-native analytics for grounding data and group-relative rewards."""
