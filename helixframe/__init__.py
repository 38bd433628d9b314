"""Spark-native analytics for sparse matrices, intervals, time axes and token sequences."""
