"""Evidence retrieval and corpus processing expressed as Spark DataFrame jobs."""
