"""Passage analytics on Spark: corpus lookup, ranked retrieval, reference extraction and streams."""
