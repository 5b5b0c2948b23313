"""Spark-native analytics for point catalogs: spatial range joins, pair counts and angular correlation functions."""

__version__ = "0.1.0"
