"""Spark-native analytics for gridded satellite time series."""
