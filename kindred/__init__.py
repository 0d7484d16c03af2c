"""Copy detection and retrieval analytics on Spark."""
