"""Versioned key-value analytics on Spark: logs, sorted runs, indexes, caches, limiters and sketches."""
