"""Spark-native analytics for labelled network flows."""
