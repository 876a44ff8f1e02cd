"""siltstone: Spark-native code and document analytics over a star of fact tables."""

__version__ = "0.1.0"
