"""Spark-native analytics over an event graph and the text behind it."""
