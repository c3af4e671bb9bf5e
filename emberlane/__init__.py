"""Spark-native analytics over event logs, region catalogues, working sets and call graphs."""

__version__ = "0.1.0"
