"""Spark-native analytics over climate-index time series."""

__version__ = "0.1.0"
