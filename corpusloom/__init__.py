"""A Spark-native engine for checking and preparing large corpora of text."""
