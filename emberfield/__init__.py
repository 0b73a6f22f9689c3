"""Spark-native analytics for geospatial thermal detections."""
