"""Spark-native analytics over tree structure models: points, patches, segments, cylinders."""
