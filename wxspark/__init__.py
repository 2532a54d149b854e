"""Spark-native analytics for forecast verification and weather archives."""
