"""Spark-native analytics for physiological and other irregular time series."""
