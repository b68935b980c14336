"""Semantic compression of knowledge bases, and query answering on what is left, on Spark."""
