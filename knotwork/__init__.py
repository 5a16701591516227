"""Spark-native analytics over knowledge hypergraphs and model transcripts."""

__version__ = "0.1.0"
