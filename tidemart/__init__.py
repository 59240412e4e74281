"""Spark-native operators for a layered real-time retail warehouse."""
