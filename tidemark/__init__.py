"""Spark-native market time-series analytics."""
