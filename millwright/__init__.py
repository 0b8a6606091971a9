"""Spark-native analytics for industrial condition monitoring and maintenance planning."""
