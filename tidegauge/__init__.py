"""Spark-native probabilistic time-series analytics."""
