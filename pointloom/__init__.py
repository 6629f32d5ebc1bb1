"""Spark-native operators over 3D scene and point tables."""
