"""Retrieval, knowledge indexing and memory analytics as Spark jobs."""
