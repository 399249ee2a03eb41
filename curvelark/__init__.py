"""Spark-native analytics for symbolic melodies and curves."""
