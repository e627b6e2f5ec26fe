"""A Spark-native engine for regime changes in ordered series."""
