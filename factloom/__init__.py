"""Provenance-aware ranking analytics, expressed as Spark DataFrame, SQL and Structured Streaming plans."""
