"""Spark-native analytics for tracer-based water-age studies."""
