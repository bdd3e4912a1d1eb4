"""Versioned, typed key-value state and its analytics on Spark."""
