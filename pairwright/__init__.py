"""Spark-native analytics over paired "act or abstain" decision data."""

__version__ = "0.1.0"
