"""Versioned key-value analytics on Spark: a snapshot is a DataFrame."""
