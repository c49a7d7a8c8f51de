"""Spark-native code- and text-retrieval engine with training-data operators."""

__version__ = "0.1.0"
