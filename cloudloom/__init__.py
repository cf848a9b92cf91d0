"""A Spark-native engine for point clouds and other spatial point tables."""

__version__ = "0.1.0"
