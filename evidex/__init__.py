"""Spark-native engine for document corpora, hybrid retrieval and evidence checks."""

__version__ = "0.1.0"
