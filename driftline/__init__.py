"""Spark-native analytics of location histories."""
