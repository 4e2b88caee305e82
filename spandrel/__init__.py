"""A Spark-native engine for crawling, auditing and cleaning web corpora."""

__version__ = "0.1.0"
