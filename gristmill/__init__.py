"""Spark-native invoice evidence engine."""
