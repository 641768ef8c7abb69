"""Retrieval and text-analytics operators as lazy Spark plans."""
