"""Typed evidence graphs on Spark: ingestion, resolution, queries, and a gate for claims."""

__version__ = "0.1.0"
