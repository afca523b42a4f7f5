"""A Spark-native engine for the lineage of analytics reports."""

__version__ = "0.1.0"
