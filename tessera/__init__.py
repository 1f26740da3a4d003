"""Spark-first engine for indexing and querying versioned documents and code."""
