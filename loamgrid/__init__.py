"""Corpus analytics and hybrid retrieval on Spark."""
