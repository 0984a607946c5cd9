"""Spark-native engine for cleaning, parsing and checking hierarchically numbered text."""
