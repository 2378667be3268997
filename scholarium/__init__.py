"""Spark-native analytics over scholarly metadata: ingest, clean, vectorise, cluster, report."""

__version__ = "0.1.0"
