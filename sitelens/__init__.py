"""Spark-native analytics for camera-image corpora and object-detection records."""
