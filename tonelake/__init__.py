"""Spark-native analytics of the language of public software-development events."""
